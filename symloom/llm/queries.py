"""Queries of the operators on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import generated, leaks, mixture, residue, syntax


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid(table(spark, d, "blob_facts")).select("blob_oid").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "blob_facts"), table(spark, d, "manifest"), table(spark, d, "graphs"))


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    x = generated.files(table(spark, d, "graphs"), table(spark, d, "manifest"), table(spark, d, "blob_facts"))
    return x.select("repo", "file", F.explode("kinds").alias("kind"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_kinds(spark, d).select("repo", "file").distinct()


def p5_hand_written(spark: SparkSession, d: str) -> DataFrame:
    """Files of the manifests that remain as hand-written source."""
    repos = table(spark, d, "graphs").where(F.col("repo").isNotNull()).select("graph_id", "repo").distinct()
    every = table(spark, d, "manifest").where(F.col("path").isNotNull()).select("graph_id", F.col("path").alias("file")).distinct().join(repos, "graph_id").select("repo", "file").distinct()
    return every.join(p5_found(spark, d), ["repo", "file"], "left_anti")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "source_weights"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.reached(p7_mixture(spark, d), table(spark, d, "source_weights"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.join(residue.residue(docs), "doc_id", "left_anti").select("doc_id", "source")


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p5_found, p5_kinds, p5_hand_written, p6_found, p6_items, p7_mixture, p7_shares, p8_found, p8_kinds, p8_kept)}

_WORDS = "list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"
_P6 = f"""WITH dw AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, {_WORDS.format(t='text')} AS w FROM eval_items WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
its AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw)),
found AS (SELECT DISTINCT ds.doc_id, its.item_id FROM ds JOIN its ON ds.s = its.s)"""
SQL = {
    "p6_found": f"{_P6} SELECT doc_id, item_id FROM found",
    "p6_items": f"{_P6} SELECT item_id, count(*) AS n_docs FROM found GROUP BY item_id",
}
