"""What changed between consecutive full snapshots of a keyed table.

Keys are mapped to persistent ordinals, kept in a table that only grows: a key keeps its ordinal however many snapshots follow (`Ordinals`).
Per snapshot and chunk of ordinals a run-compressed bitmap of the keys present and a column vector of row fingerprints, aligned by
ordinal, are built. AND-NOT of neighbouring bitmaps, run by run, gives what was added and removed; comparing the vectors under AND
gives what changed. A chunk holds a bounded number of rows however large the table is, and all snapshots of a key are in its chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Rows aimed at in a chunk, over all snapshots of its keys.
BLOCK_ROWS = 20_000
#: Bits of an ordinal below its block number.
LOCAL_BITS = 24


def snapshot_order(graphs: DataFrame) -> DataFrame:
    """(graph_id, repo, seq): seq counts the snapshots of a repo by committed_at (ties by graph_id), from 0.

    Repeated rows of a graph_id count once (that with the smallest repo and committed_at). Rows without graph_id, repo or
    committed_at belong to no series and are left out. The window holds the snapshots of one repository, a few ids each.
    """
    from pyspark.sql import Window as W

    one = graphs.where(F.col("graph_id").isNotNull() & F.col("repo").isNotNull() & F.col("committed_at").isNotNull())
    one = one.groupBy("graph_id").agg(F.min(F.struct("repo", "committed_at")).alias("x")).select("graph_id", "x.repo", "x.committed_at")
    return one.withColumn("seq", F.row_number().over(W.partitionBy("repo").orderBy("committed_at", "graph_id")) - 1).select("graph_id", "repo", "seq")


def tagged(*cols: Column) -> Column:
    """The columns as one string in which a null differs from every value."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols])


def fingerprint(*cols: Column) -> Column:
    """64 bits of the columns' values; a null differs from every value, nested values compare by their JSON."""
    return F.xxhash64(tagged(*cols))


def blocks_for(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS))


def chunk_bits(rows: int, keys: int) -> int:
    """Low bits of an ordinal that a chunk spans, so that it holds about BLOCK_ROWS rows at that many rows a key."""
    return min(LOCAL_BITS, max(0, int(BLOCK_ROWS * keys / max(1, rows)).bit_length() - 1))


class Ordinals:
    """A table (keys..., ord) in a folder: each key has one ordinal for good, and new keys are appended behind the old ones of their block.

    A key's hash picks its block; ord is the block's number above LOCAL_BITS and the place within below. The number of blocks is settled when
    the table is begun. Repeated keys count once; keys with a null are left out. Without a folder the table lives in the shared folder
    of the session, for one run.
    """

    def __init__(self, spark: SparkSession, keys: list[str], blocks: int, folder: str | None = None):
        self.spark, self.keys, self.folder = spark, keys, folder
        self.table: DataFrame | None = None
        self.blocks = blocks
        if folder is not None:
            try:
                self.table = spark.read.parquet(f"{folder}/keys")
                self.blocks = spark.read.parquet(f"{folder}/blocks").first()["blocks"]
            except Exception as e:  # noqa: BLE001 - a table that is not there yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                spark.createDataFrame([(blocks,)], "blocks int").write.mode("overwrite").parquet(f"{folder}/blocks")

    def extend(self, rows: DataFrame) -> DataFrame:
        """The table with the keys of rows added. One shuffle by key and one by block; old rows are neither moved nor numbered anew."""
        from pyspark.sql import Window as W

        new = rows.select(*self.keys).dropna().distinct()
        block = F.pmod(F.xxhash64(*self.keys), F.lit(self.blocks)).cast("long")
        start = F.lit(0)
        if self.table is not None:
            new = new.join(self.table.select(*self.keys), self.keys, "left_anti")
        new = new.withColumn("__b", block)
        if self.table is not None:
            held = self.table.groupBy(F.shiftright("ord", LOCAL_BITS).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))  # a row per block
            new, start = new.join(held, "__b", "left"), F.coalesce("__n", F.lit(0))
        place = F.row_number().over(W.partitionBy("__b").orderBy(*self.keys)) - 1 + start
        new = new.select(*self.keys, (F.shiftleft("__b", LOCAL_BITS) + place).alias("ord"))
        if self.folder is None:
            new = cut(new)
            self.table = new if self.table is None else self.table.unionByName(new)
        else:
            new.write.mode("append").parquet(f"{self.folder}/keys")
            self.table = self.spark.read.parquet(f"{self.folder}/keys")
        return self.table


# bitmaps as runs: a sorted array of borders, at which membership begins and ends in turn


def runs(ords: np.ndarray) -> np.ndarray:
    """The bitmap of sorted distinct ordinals."""
    if not len(ords):
        return np.zeros(0, np.int64)
    gap = np.flatnonzero(np.diff(ords) != 1)
    out = np.empty(2 * (len(gap) + 1), np.int64)
    out[0::2] = ords[np.concatenate(([0], gap + 1))]
    out[1::2] = ords[np.concatenate((gap, [len(ords) - 1]))] + 1
    return out


def _combined(a: np.ndarray, b: np.ndarray, inverted: bool) -> np.ndarray:
    """Borders of a AND b, or with `inverted` of a AND NOT b, by one merge of both lists of borders."""
    at = np.concatenate((a, b))
    order = np.argsort(at, kind="stable")
    of_a = order < len(a)
    in_a = np.cumsum(of_a) % 2 == 1
    in_b = np.cumsum(~of_a) % 2 == 1
    at, inside = at[order], in_a & (in_b ^ inverted)
    last = np.ones(len(at), bool)
    last[:-1] = at[1:] != at[:-1]  # of borders at one place only the state after all of them counts
    at, inside = at[last], inside[last]
    return at[inside != np.concatenate(([False], inside[:-1]))]


def and_not(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _combined(a, b, True)


def both_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _combined(a, b, False)


def members(borders: np.ndarray) -> np.ndarray:
    """The ordinals of a bitmap."""
    start, n = borders[0::2], borders[1::2] - borders[0::2]
    total = int(n.sum())
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total) if total else np.zeros(0, np.int64)


def _mixed(mark: np.ndarray) -> np.ndarray:
    """Marks spread over 64 bits, so that sums of them stand for sets."""
    x = mark.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def diff_block(series: np.ndarray, seq: np.ndarray, final: np.ndarray, keys: list[np.ndarray], mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of rows, the seq of the later snapshot and the change (0 added, 1 removed, 2 changed) within one chunk.

    series, seq: which snapshot a row is of. final: whether it is the series' last one, after which nothing is removed. keys: the key
    columns, ordinals or made of them. mark: fingerprints. Rows that repeat a key within a snapshot count once; if they differ, the set of their marks
    is compared, in whatever order they come.
    """
    z = np.zeros(0, np.int64)
    if not len(series):
        return z, z, z.astype(np.int8)
    index, at, change = [], [], []
    order = np.lexsort([mark, seq, *keys[::-1], series])
    s, q, m = series[order], seq[order], mark[order]
    new = np.ones(len(order), bool)
    same = s[1:] == s[:-1]
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    new[1:] = ~same
    ordinal = np.cumsum(new) - 1  # of (series, key) in this chunk, in the order of the stored ordinals
    apart = np.ones(len(order), bool)
    apart[1:] = new[1:] | (q[1:] != q[:-1])
    if not apart.all():
        fresh = apart.copy()
        fresh[1:] |= m[1:] != m[:-1]
        start = np.flatnonzero(apart)
        several = np.add.reduceat(fresh.astype(np.int64), start) > 1
        sums = np.add.reduceat(np.where(fresh, _mixed(m), 0), start)
        m = np.where(several, sums, m[start].astype(np.int64))
        s, q, ordinal, order = s[start], q[start], ordinal[start], order[start]
    # one bitmap and one vector per step for all series of the chunk: ordinals of different series don't meet
    n = int(ordinal[-1]) + 1
    ends = final[order].astype(bool)
    by_step = np.argsort(q, kind="stable")  # ordinals stay sorted within a step
    steps, start = np.unique(q[by_step], return_index=True)
    of = dict(zip(steps.tolist(), np.split(by_step, start[1:])))
    before, old, old_vector, old_place = -1, z, np.zeros(n, np.int64), np.zeros(n, np.int64)
    for step in sorted({*of, *(x + 1 for x in of)}):
        mine = of.get(step, z)
        now, vector, place = runs(ordinal[mine]), np.zeros(n, np.int64), np.zeros(n, np.int64)
        vector[ordinal[mine]], place[ordinal[mine]] = m[mine], mine
        if before != step - 1:
            old = z
        if step:
            common, gone = members(both_of(now, old)), members(and_not(old, now))
            moved = common[vector[common] != old_vector[common]]
            gone = old_place[gone]
            for kind, found in enumerate((place[members(and_not(now, old))], gone[~ends[gone]], place[moved])):
                if len(found):
                    index.append(order[found])
                    at.append(np.full(len(found), step))
                    change.append(np.full(len(found), kind, np.int8))
        before, old, old_vector, old_place = step, now, vector, place
    if not index:
        return z, z, z.astype(np.int8)
    return np.concatenate(index), np.concatenate(at), np.concatenate(change)


CHANGES = ("added", "removed", "changed")


def diff_blocks(rows: DataFrame, series: str, keys: list[str], block: Column, partitions: int | None = None) -> DataFrame:
    """Differences of consecutive snapshots: (series, keys..., seq, change).

    rows has the integer columns `series`, seq, the flag final (the series' last snapshot), the integer `keys` and the fingerprint `mark`. `block`
    spreads rows by key, so that no task gets an unbounded group. seq is that of the later snapshot.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"{series} {kinds[series]}, " + ", ".join(f"{k} {kinds[k]}" for k in keys) + ", seq int, change string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, at, change = diff_block(pdf[series].to_numpy(), pdf["at"].to_numpy() >> 1, pdf["at"].to_numpy() & 1, [pdf[k].to_numpy() for k in keys], pdf["mark"].to_numpy())
        out = pdf[[series, *keys]].iloc[i].copy()
        out["seq"], out["change"] = at.astype("int32"), np.array(CHANGES, object)[change]
        return out

    at = F.shiftleft("seq", 1) + F.col("final").cast("int")
    return rows.select(series, at.alias("at"), *keys, "mark", block.alias("__block")).groupBy("__block").applyInPandas(run, schema)
