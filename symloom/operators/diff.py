"""Differences of two graphs, new paths, ages and files that change together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import matches
from ..graph import CodeGraph
from ..model import CALL_FAMILY
from ..session import cut
from . import walk
from .filters import EdgeFilter

#: What makes two edges the same, and what may change.
IDENTITY = ("src_fqn", "dst_fqn", "kind", "file", "anchor")
CHANGING_RAW = ("condition", "confidence", "tier", "cfg_condition")
CHANGING = ("condition", "confidence", "tier", "group_size", "cfg_condition")


def identified(g: CodeGraph, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges by identity: names of both ends, kind, the caller's file and the call site's place among the caller's statements (-1 for edges without a
    site); no lines, so moved lines don't count. Of edges with one identity the last by id stands. Group numbers are only
    counters, so the group's size is compared. by: columns of nodes and edges that part many graphs in one; they belong to the identity.
    """
    n = g.node_rows("fqn", "file")
    e = g.edge_rows(*by, "src", "dst", "kind", "candidate_group", "stmt_index", *CHANGING_RAW)
    e = e.join(n.select(F.col("nid").alias("src"), F.col("fqn").alias("src_fqn"), "file"), "src").join(n.select(F.col("nid").alias("dst"), F.col("fqn").alias("dst_fqn")), "dst")
    e = e.join(g.group_sizes, "candidate_group", "left").withColumn("group_size", F.coalesce("size", F.lit(0))).withColumn("anchor", F.coalesce("stmt_index", F.lit(-1)))
    best = e.groupBy(*by, *IDENTITY).agg(F.max(F.struct("eid", *CHANGING)).alias("x"))
    return best.select(*by, *IDENTITY, "x.*")


def diff_graphs(base: CodeGraph, head: CodeGraph, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., record_type, fqn, dst_fqn, kind, file, anchor, change, what): added, removed and changed edges, added and removed nodes (by name).

    by: see identified; graphs are compared where these columns are equal.
    """
    b, h = identified(base, by), identified(head, by)
    both = b.select(*by, *IDENTITY, F.struct(*CHANGING).alias("b")).join(h.select(*by, *IDENTITY, F.struct(*CHANGING).alias("h")), [*by, *IDENTITY], "full_outer")
    moved = F.array_compact(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}")), F.lit(c)) for c in CHANGING]))
    change = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.size(moved) > 0, "changed")
    conditions = F.array(F.col("b.condition"), F.col("h.condition"))
    e = both.withColumn("change", change).where(F.col("change").isNotNull()).select(
        *by, F.lit("edge").alias("record_type"), F.col("src_fqn").alias("fqn"), "dst_fqn", "kind", "file", "anchor", "change", F.when(F.col("change") == "changed", F.array_join(moved, ",")).otherwise("").alias("what"), conditions.alias("conditions")
    )
    names = lambda g, flag: g.raw_nodes.select(*by, "fqn").distinct().withColumn(flag, F.lit(True))
    n = names(base, "b").join(names(head, "h"), [*by, "fqn"], "full_outer").where(F.col("b").isNull() | F.col("h").isNull())
    n = n.select(*by, F.lit("node").alias("record_type"), "fqn", F.lit("").alias("dst_fqn"), F.lit("").alias("kind"), F.lit("").alias("file"), F.lit(-1).alias("anchor"), F.when(F.col("b").isNull(), "added").otherwise("removed").alias("change"), F.lit("").alias("what"), F.array().cast("array<string>").alias("conditions"))
    return e.unionByName(n)


@dataclass(frozen=True)
class DiffFilter:
    """Which differences are shown; no bucket means all. Any predicate on edges hides the nodes. A changed edge fits a condition by either side."""

    buckets: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    condition: str | None = None
    source: str | None = None
    target: str | None = None

    def apply(self, d: DataFrame) -> DataFrame:
        if self.buckets:
            d = d.where(F.col("change").isin(*self.buckets))
        if self.kinds or self.condition or self.source or self.target:
            d = d.where(F.col("record_type") == "edge")
        if self.kinds:
            d = d.where(F.col("kind").isin(*self.kinds))
        if self.condition:
            d = d.where(F.array_contains("conditions", self.condition))
        if self.source:
            d = d.where(matches(self.source, F.col("fqn")))
        if self.target:
            d = d.where(matches(self.target, F.col("dst_fqn")))
        return d


def newer_edges(base: CodeGraph, head: CodeGraph, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges of head whose identity base lacks. by: see identified."""
    return identified(head, by).join(identified(base, by).select(*by, *IDENTITY), [*by, *IDENTITY], "left_anti").drop("eid")


def new_paths(base: CodeGraph, head: CodeGraph, source: str, target: str) -> DataFrame:
    """(source, target, depth): ordered pairs of names, one in reach of the other at head but not at base, over calls and data flow."""
    admit = EdgeFilter(kinds=(*CALL_FAMILY, "derives-from"))

    def pairs(g: CodeGraph, ends: DataFrame | None = None) -> DataFrame:
        """(source, target, root, node): pairs in reach, by sets of nodes alone."""
        a = g.raw_nodes.where(matches(source, F.col("fqn"))).select(F.col("nid").alias("root"), F.col("fqn").alias("source")).distinct()
        z = g.raw_nodes.where(matches(target, F.col("fqn"))).select(F.col("nid").alias("node"), F.col("fqn").alias("target")).distinct()
        found = walk.reached(walk.oriented(admit.raw(g)), a.select("root", F.col("root").alias("node")), by_root=True).where(F.col("root") != F.col("node"))
        return found.join(z, "node").join(a, "root").select("source", "target", "root", "node")

    new = cut(pairs(head).join(pairs(base).select("source", "target").distinct(), ["source", "target"], "left_anti"))
    # depths are asked for the new pairs alone, and a root is left once its goals are met
    deep = walk.bfs(walk.oriented(admit.raw(head)), new.select("root", F.col("root").alias("node")), None, new.select("root", "node"))
    return new.join(deep.select("root", "node", "depth"), ["root", "node"]).groupBy("source", "target").agg(F.min("depth").alias("depth"))


def edge_age(edges: DataFrame, blame: DataFrame) -> DataFrame:
    """(eid, commit, author, author_time): the latest commit that touched the caller's lines.

    edges: (eid, file, line_start, line_end); blame: (file, line, commit, author, author_time). Ties go to the larger commit id.
    """
    lines = edges.select("eid", "file", F.explode(F.sequence("line_start", "line_end")).alias("line"))
    x = lines.join(blame, ["file", "line"]).groupBy("eid").agg(F.max(F.struct("author_time", "commit", "author")).alias("x"))
    return x.select("eid", "x.commit", "x.author", "x.author_time")


def coupling(commits: DataFrame, max_files: int = 50, min_cochanges: int = 2, limit: int | None = 50) -> DataFrame:
    """(file_a, file_b, cochanges, changes_a, changes_b): files that change in the same commits.

    commits: (commit, n_parents, path). Merges and root commits don't count, nor do commits of more than max_files files (0: no bound), which is
    what keeps the pairs of one commit few. Ordered by cochanges, then names; pairs below min_cochanges are left out.
    """
    one = commits.where((F.col("n_parents") == 1) & F.col("path").isNotNull() & F.col("commit").isNotNull()).select("commit", "path").distinct()
    files = one.groupBy("commit").agg(F.count(F.lit(1)).alias("n"))
    if max_files:
        files = files.where(F.col("n") <= max_files)
    kept = cut(one.join(files.select("commit"), "commit", "left_semi"))
    per = kept.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    a, b = kept.withColumnRenamed("path", "file_a"), kept.withColumnRenamed("path", "file_b")
    both = a.join(b, "commit").where(F.col("file_a") < F.col("file_b")).groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("cochanges")).where(F.col("cochanges") >= min_cochanges)
    out = both.join(per.select(F.col("path").alias("file_a"), F.col("n").alias("changes_a")), "file_a").join(per.select(F.col("path").alias("file_b"), F.col("n").alias("changes_b")), "file_b")
    out = out.select("file_a", "file_b", "cochanges", "changes_a", "changes_b").orderBy(F.desc("cochanges"), "file_a", "file_b")
    return out if limit is None else out.limit(limit)


def changed_nodes(base: CodeGraph, head: CodeGraph, base_manifest: DataFrame, head_manifest: DataFrame) -> DataFrame:
    """(nid): nodes of head that changed: ends of changed edges, new nodes, and all of files whose blob changed."""
    d = diff_graphs(base, head)
    names = d.where(F.col("change") != "removed").select(F.explode(F.array("fqn", "dst_fqn")).alias("fqn")).where(F.col("fqn") != "").distinct()
    files = head_manifest.select("path", "blob_oid").distinct().join(base_manifest.select("path", "blob_oid").distinct(), ["path", "blob_oid"], "left_anti").select(F.col("path").alias("file")).distinct()
    by_name = head.nodes.join(names, "fqn", "left_semi").select("nid")
    return by_name.unionByName(head.nodes.join(files, "file", "left_semi").select("nid")).distinct()


def dirty_files(indexed: DataFrame, work: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., path, state): files that differ between two manifests (by..., path, blob_oid): added, removed or modified."""
    a = indexed.select(*by, "path", F.col("blob_oid").alias("a")).distinct()
    b = work.select(*by, "path", F.col("blob_oid").alias("b")).distinct()
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, [*by, "path"], "full_outer").withColumn("state", state).where(F.col("state").isNotNull()).select(*by, "path", "state")
