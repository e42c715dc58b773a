"""Per-key results that do not hang on a few heavy keys: dense accumulator arrays.

Keys are small integers within a group (the dictionary code). Every input split counts its own rows with numpy bincount into
blocks of BLOCK counters; only blocks travel, and a two-step reduction adds them up. So a key that holds a third of all rows
costs one counter per split and block instead of one huge task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters in one block.
BLOCK = 1024
#: Rows counted at once, and bytes of counters that an array or the blocks held may take: bounds of a task's memory.
CHUNK_ROWS, HELD_BYTES = 2_000_000, 64 << 20
HELD_BLOCKS = HELD_BYTES // (8 * BLOCK)
#: Parts into which the partial blocks of one place are split for the first step of the reduction.
FAN_IN = 16


def _count(groups: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, block, counters) of rows: bincount over the blocks that occur, at most HELD_BLOCKS of them in one array however sparse the codes are."""
    if not len(codes):
        return
    names, inverse = np.unique(groups, return_inverse=True)
    block = codes // BLOCK
    width = int(block.max()) + 1
    key = inverse * width + block
    if len(names) * width <= HELD_BLOCKS:  # a small range needs no sorting
        present = np.flatnonzero(np.bincount(key, minlength=1))
        place = np.searchsorted(present, key)
    else:
        present, place = np.unique(key, return_inverse=True)
    within = codes % BLOCK
    order = np.argsort(place, kind="stable") if len(present) > HELD_BLOCKS else None
    if order is not None:
        place, within = place[order], within[order]
    for low in range(0, len(present), HELD_BLOCKS):
        high = min(len(present), low + HELD_BLOCKS)
        a, b = (0, len(place)) if order is None else np.searchsorted(place, (low, high))
        total = np.bincount((place[a:b] - low) * BLOCK + within[a:b], minlength=(high - low) * BLOCK).reshape(-1, BLOCK)
        for k, row in zip(present[low:high], total):
            yield names[k // width], int(k % width), row


def _emit(held: dict) -> pa.RecordBatch:
    idx = [np.flatnonzero(v).astype(np.int16) for v in held.values()]
    return pd.DataFrame({"grp": np.array([k[0] for k in held], np.int64), "block": np.array([k[1] for k in held], np.int64), "idx": idx, "cnt": [v[i] for v, i in zip(held.values(), idx)]})


def _accumulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict = {}
    waiting, rows = [], 0

    def fold() -> Iterator[pd.DataFrame]:
        groups = np.concatenate([x["grp"].to_numpy() for x in waiting])
        codes = np.concatenate([x["code"].to_numpy() for x in waiting])
        for g, b, row in _count(groups, codes):
            if (g, b) in held:
                held[g, b] = held[g, b] + row
            else:
                held[g, b] = row.copy()
            if len(held) >= HELD_BLOCKS:
                yield _emit(held)
                held.clear()

    for x in frames:
        waiting.append(x)
        rows += len(x)
        if rows >= CHUNK_ROWS:
            yield from fold()
            waiting, rows = [], 0
    if waiting:
        yield from fold()
    if held:
        yield _emit(held)


def _add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict = {}
    for x in frames:
        for g, b, i, c in zip(x["grp"], x["block"], x["idx"], x["cnt"]):
            row = held.get((g, b))
            if row is None:
                row = held[g, b] = np.zeros(BLOCK, np.int64)
            row[np.asarray(i, np.int64)] += c
        if len(held) > HELD_BLOCKS:  # a partial sum is as good an input for the next step
            yield _emit(held)
            held.clear()
    if held:
        yield _emit(held)


SCHEMA = "grp long, block long, idx array<short>, cnt array<long>"


def dense_counts(rows: DataFrame) -> DataFrame:
    """(grp, code, n): how many rows each code has, from rows (grp long, code long >= 0). Rows with nulls are dropped.

    grp is a side or a graph; codes are dense within it. Splits of the input are counted as they are.
    """
    clean = rows.where(F.col("grp").isNotNull() & (F.col("code") >= 0)).select(F.col("grp").cast("long"), F.col("code").cast("long"))
    partial = clean.mapInPandas(_accumulate, SCHEMA)
    # blocks of one place from many splits: add up FAN_IN parts apart, then these
    parts = partial.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    some = parts.repartition("grp", "block", "part").drop("part").mapInPandas(_add, SCHEMA)
    sums = some.repartition("grp", "block").mapInPandas(_add, SCHEMA)
    each = sums.select("grp", "block", F.explode(F.arrays_zip("idx", "cnt")).alias("x"))
    return each.groupBy("grp", (F.col("block") * BLOCK + F.col("x.idx")).alias("code")).agg(F.sum("x.cnt").alias("n"))


def dictionary(keys: DataFrame, name: str, rows_per_block: int = 100_000) -> DataFrame:
    """(name, code): dense codes 0..n-1 for the distinct values of a column; nulls get none.

    Values are spread over blocks by hash and numbered within each; the blocks' sizes, a few numbers, give the offsets.
    """
    from pyspark.sql import Window as W

    from ..session import cut

    own = cut(keys.where(F.col(name).isNotNull()).select(name).distinct())
    n = own.count()
    blocks = max(1, -(-n // rows_per_block))
    local = own.withColumn("__b", F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")).withColumn("__i", F.row_number().over(W.partitionBy("__b").orderBy(name)) - 1)
    local = cut(local, drop=own)
    sizes = local.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # one row per block: n / rows_per_block rows in this window
    start = sizes.select("__b", (F.sum("__n").over(W.orderBy("__b")) - F.col("__n")).alias("__start"))
    return local.join(start, "__b").select(name, (F.col("__start") + F.col("__i")).alias("code"))
