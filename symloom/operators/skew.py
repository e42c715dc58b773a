"""Joins and keys that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on; so at most 1 / HOT_SHARE keys are hot, which bounds what is broadcast.
HOT_SHARE = 0.001
#: Below this many rows a key is no trouble for one task.
HOT_FLOOR = 200_000
#: Parts into which the rows of a hot key are split.
SALTS = 64


def hot_keys(df: DataFrame, on: list[str], floor: int = HOT_FLOOR, share: float = HOT_SHARE) -> list[tuple]:
    """Keys of df that hold at least `share` of its rows and `floor` rows: no more than 1 / share of them.

    One aggregation with map-side partial counts. Keys with a null are left out, as an equi-join drops them.
    """
    counts = df.where(_all_set(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    big = counts.where(F.col("__n") >= floor).orderBy(F.desc("__n")).limit(int(1 / share) + 1)
    rows = big.collect()
    if not rows:
        return []
    total = df.count()
    return [tuple(r[k] for k in on) for r in rows if r["__n"] >= total * share]


def _all_set(on: list[str]) -> Column:
    c = F.lit(True)
    for k in on:
        c = c & F.col(k).isNotNull()
    return c


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot: list[tuple] | None = None, salts: int = SALTS) -> DataFrame:
    """left joined to right on equal names, where left may be skewed; right holds a key once or a few times.

    `hot` (of hot_keys) are left's hot keys, by default none; their rows are spread over `salts` parts, and only those rows of
    right are repeated. Everything else is a plain equi-join, so Spark picks the join. Null keys match nothing. The part is a hash of the row's own
    values, so a task that runs again after a loss splits its rows the same way.
    """
    if not hot:
        return left.join(right, on, how)
    spark = left.sparkSession
    fields = [left.schema[k] for k in on]
    from pyspark.sql.types import StructType

    keys = F.broadcast(spark.createDataFrame(hot, StructType(fields)).withColumn("__hot", F.lit(True)))  # at most 1 / HOT_SHARE rows
    l = left.join(keys, on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("__hot")
    r = right.join(keys, on, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return l.join(r, [*on, "__salt"], how).drop("__salt")
