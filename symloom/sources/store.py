"""A store of graphs as partitioned Parquet, and a cache of facts by file content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..link.facts import Facts
from ..session import _delete, cut, discard

TABLES = ("nodes", "edges", "candidates")


class Store:
    """A folder with one table each of nodes, edges and candidates, partitioned by graph_id; writing a graph replaces its partitions alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def put(self, graph_id: int, nodes: DataFrame, edges: DataFrame, candidates: DataFrame) -> None:
        """Write a graph. Rows are made distinct here, once, so that readers need not; tables are clustered by their joins' keys. A table without rows
        leaves no partition of the graph's earlier state behind."""
        for name, df in zip(TABLES, (nodes, edges, candidates)):
            order = {"nodes": "node_id", "edges": "src", "candidates": "candidate_group"}[name]
            path = f"{self.path(name)}/graph_id={graph_id}"
            df.drop("graph_id").distinct().repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode("overwrite").parquet(path)

    def read(self, graph_id: int | None = None) -> CodeGraph:
        tables = []
        for name in TABLES:
            df = self.spark.read.parquet(self.path(name))
            tables.append(df if graph_id is None else df.where(F.col("graph_id") == graph_id))
        return CodeGraph.of(*tables, unique=True)

    def graph_ids(self) -> list[int]:
        """Ids of the graphs held, read from the partitions."""
        return sorted(r["graph_id"] for r in self.spark.read.parquet(self.path("nodes")).select("graph_id").distinct().collect())

    def point(self, repo: str, tree_oid: str, graph_id: int) -> None:
        """Say that a repository's current tree is held as a graph. The newest pointer counts; the rows before it are its history."""
        seq = 1 + max((r["seq"] for r in self._pointers(repo)), default=-1)
        self.spark.createDataFrame([(repo, tree_oid, graph_id, seq)], "repo string, tree_oid string, graph_id int, seq int").write.mode("append").parquet(self.path("heads"))

    def _pointers(self, repo: str) -> list:
        try:
            return self.spark.read.parquet(self.path("heads")).where(F.col("repo") == repo).orderBy(F.desc("seq")).limit(1).collect()
        except Exception as e:  # noqa: BLE001 - nothing was pointed at yet
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def head(self, repo: str, tree_oid: str | None = None) -> tuple[int, bool] | None:
        """(graph_id, fresh) of the graph that stands for a repository; fresh tells whether it is of this tree. None if there is none."""
        r = self._pointers(repo)
        return (r[0]["graph_id"], tree_oid is None or r[0]["tree_oid"] == tree_oid) if r else None

    def prune(self, live: list[int]) -> list[int]:
        """Drop all graphs but the live ones; gives the ids dropped."""
        gone = [g for g in self.graph_ids() if g not in set(live)]
        for g in gone:
            for name in TABLES:
                _delete(self.spark, f"{self.path(name)}/graph_id={g}")
        return gone


def overlay(base: DataFrame, over: DataFrame, key: str = "path") -> DataFrame:
    """base without what `over` holds under the same key, and `over`: a view of a changed working folder over a stored tree."""
    return base.join(over.select(key).distinct(), key, "left_anti").unionByName(over)


class Fragments:
    """Facts of files by (blob_oid, path, version): a file is read again only if its content, place or the reader's version changed."""

    def __init__(self, spark: SparkSession, folder: str, version: int):
        self.spark, self.folder, self.version = spark, folder, version

    def known(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.folder).where(F.col("version") == self.version)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def missing(self, sources: DataFrame) -> DataFrame:
        known = self.known()
        return sources if known is None else sources.join(known.select("blob_oid", "path").distinct(), ["blob_oid", "path"], "left_anti")

    def add(self, facts: DataFrame) -> None:
        """facts has blob_oid, path and whatever was read."""
        facts.withColumn("version", F.lit(self.version)).write.mode("append").parquet(self.folder)

    def prune(self, manifests: DataFrame) -> None:
        """Keep the facts of the contents that manifests (path, blob_oid) still name, of this reader's version, and drop all others."""
        known = self.known()
        if known is None:
            return
        kept = cut(known.join(manifests.select("path", "blob_oid").distinct(), ["path", "blob_oid"], "left_semi"))
        kept.write.mode("overwrite").parquet(self.folder)
        discard(kept)


def function_hashes(facts: Facts) -> DataFrame:
    """(path, fn, hash): 64 bits over all that the reading of a function found: its definition, calls in order, and flows. Lines don't count, so a function
    that merely moved keeps its hash."""
    scopes = facts.scopes.where(F.col("owner_fqn").isNotNull()).select("path", "scope", F.col("owner_fqn").alias("fn"))
    d = facts.defs.select("path", F.col("fqn").alias("fn"), F.xxhash64(F.lit("d"), "kind", "visibility", "arity", "own_effects", "is_abstract", F.to_json("signature")).alias("h"))
    r = facts.refs.join(scopes, ["path", "scope"]).select("path", "fn", F.xxhash64(F.lit("r"), F.array_join("name_path", "::"), "ref_kind", "condition", "stmt_index", "arity").alias("h"))
    f = facts.flows.select("path", "fn", F.xxhash64(F.lit("f"), "pos", "derived", "derived_version", "source", "transform", "condition", "callee", F.array_join("args", ",", "?")).alias("h"))
    every = d.unionByName(r).unionByName(f)
    # sums of mixed hashes don't depend on the order of rows; as decimals they can't overflow
    return every.groupBy("path", "fn").agg(F.xxhash64(F.sum(F.col("h").cast("decimal(38,0)")), F.sum(F.xxhash64("h", F.lit(7)).cast("decimal(38,0)")), F.count(F.lit(1))).alias("hash"))


def recomputed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, fn, state) of each function of new: reused if old holds it with the same hash, else recomputed."""
    o = old.select("path", "fn", F.col("hash").alias("old"))
    return new.join(o, ["path", "fn"], "left").select("path", "fn", F.when(F.col("old") == F.col("hash"), "reused").otherwise("recomputed").alias("state"))
