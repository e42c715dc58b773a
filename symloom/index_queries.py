"""Queries that index source files: facts of all files of all snapshots, and counts over a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import light_frontend, python_frontend
from .session import shared_dir, table
from .streaming.incremental import drained, kind_counts


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(blob_oid, path, content, lang): each content once per path it is found at."""
    b = table(spark, d, "blob_facts").where(F.col("content").isNotNull()).groupBy("blob_oid").agg(F.min("content").alias("content"), F.min("lang").alias("lang"))
    m = table(spark, d, "manifest").where(F.col("path").isNotNull()).select("blob_oid", "path").distinct()
    return m.join(b, "blob_oid")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    return python_frontend.read(s).unionByName(light_frontend.read(s))


def index_defs(spark: SparkSession, d: str) -> DataFrame:
    """Definitions read from the files, per language and kind."""
    return python_frontend.facts(_facts(spark, d)).defs.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


def index_refs(spark: SparkSession, d: str) -> DataFrame:
    """References read from the files, per language, kind and condition."""
    return python_frontend.facts(_facts(spark, d)).refs.groupBy("lang", "ref_kind", "condition").agg(F.count(F.lit(1)).alias("n"))


def stream_edge_kinds(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges").select("graph_id", "edge_id", "kind")
    # a pattern, as a stream takes a folder or a pattern, and the table may be one file
    stream = spark.readStream.schema(table(spark, d, "edges").schema).parquet(f"{d}/edges.parque[t]").select(*edges.columns)
    return drained(kind_counts(stream), f"{shared_dir(spark)}/symloom/stream-{uuid.uuid4().hex}")


QUERIES = {f.__name__: f for f in (index_defs, index_refs, stream_edge_kinds)}
SQL = {"stream_edge_kinds": "SELECT graph_id, kind, count(*) AS n FROM (SELECT DISTINCT graph_id, edge_id, kind FROM edges) GROUP BY ALL"}
