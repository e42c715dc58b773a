"""Numbers in a total order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def dense_order(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with `name`: 0, 1, ... in the given total order. Rows are ranged over partitions; only the partitions' sizes meet in one place."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    held = cut(ranged)
    local = held.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1)
    sizes = held.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    start = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__start"))  # a row per partition
    return local.join(start, "__p").withColumn(name, (F.col("__start") + F.col("__i")).cast("long")).drop("__p", "__i", "__start")
