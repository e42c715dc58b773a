"""Indexing as a stream: new contents are read once, as they arrive; late and repeated rows do no harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Fragments


def watch(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the rows of Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def index_stream(sources: DataFrame, cache: Fragments, read: Callable[[DataFrame], DataFrame], checkpoint: str, after: Callable[[int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Reads facts of sources (blob_oid, path, content) that the cache lacks and adds them, batch by batch.

    A batch that runs again after a failure finds its files in the cache and adds nothing, so each file's facts stand once. `after` is called with
    the batch's number, for instance to link anew.
    """

    def step(batch: DataFrame, number: int) -> None:
        new = cache.missing(batch.dropDuplicates(["blob_oid", "path"]))
        cache.add(read(new))
        if after:
            after(number)

    w = sources.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def edge_counts(edges: DataFrame, time: str = "loaded_at", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """A stream's edges per graph, kind and window of arrival; rows later than `late` behind the latest are dropped, repeated ones count once."""
    e = edges.withWatermark(time, late).dropDuplicatesWithinWatermark(["graph_id", "edge_id"])
    return e.groupBy(F.window(time, window), "graph_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def kind_counts(edges: DataFrame) -> DataFrame:
    """A stream's distinct edges per graph and kind."""
    return edges.dropDuplicates(["graph_id", "edge_id"]).groupBy("graph_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """The table a stream's aggregate has come to once all that is there has been read."""
    from ..session import cut

    last: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        last[:] = [cut(batch, drop=last[0] if last else None)]

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return last[0] if last else stream.sparkSession.createDataFrame([], stream.schema)
