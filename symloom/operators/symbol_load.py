"""Per-symbol results over all edges, with the load of heavy symbols spread evenly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .dense import dense_counts, dictionary
from .skew import hot_keys, lookup_join

SIDES = ("src", "dst")


def _once(edges: DataFrame) -> DataFrame:
    """Exact duplicates count once; edges without graph_id are left out."""
    return edges.where(F.col("graph_id").isNotNull()).select("graph_id", "edge_id", "src", "dst").distinct()


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("fqn").isNotNull()).select("graph_id", "node_id", "fqn").groupBy("graph_id", "node_id").agg(F.min("fqn").alias("fqn"))


def side_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(side, fqn, n): edges on which a symbol stands, by fqn over all graphs.

    node_id is the dictionary code within a graph, so edges are counted before anything is joined. Ids without a node or a node
    without fqn give no row.
    """
    return _counts(_once(edges), nodes)


def _counts(once: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = once.select(F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(s).alias("code")) for i, s in enumerate(SIDES)])).alias("x"), "graph_id")
    counts = dense_counts(ends.select((F.col("graph_id").cast("long") * 2 + F.col("x.side")).alias("grp"), F.col("x.code").alias("code")))
    keyed = counts.select(F.floor(F.col("grp") / 2).cast("int").alias("graph_id"), F.pmod("grp", F.lit(2)).alias("side"), F.col("code").cast("int").alias("node_id"), "n")
    by_name = keyed.join(_named(nodes), ["graph_id", "node_id"]).groupBy("side", "fqn").agg(F.sum("n").alias("n"))
    return by_name.select(F.when(F.col("side") == 0, "src").otherwise("dst").alias("side"), "fqn", "n")


def heavy(edges: DataFrame, nodes: DataFrame, share: float = 0.04) -> DataFrame:
    """(side, fqn) of the symbols that stand on that side of at least `share` of all edges; without edges no rows."""
    e = cut(_once(edges))
    total = e.count()
    counts = _counts(e, nodes)
    return counts.where(F.col("n") >= share * total).select("side", "fqn")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(side, fqn, n_edges, n_peers): edges and distinct peers (by fqn) of each symbol on each side.

    Pairs of symbols are made distinct on both ids together, so they spread evenly; each side is then counted by dense arrays.
    """
    e = cut(_once(edges))
    codes = cut(dictionary(nodes, "fqn"))
    ids = cut(_named(nodes).join(codes, "fqn").select("graph_id", "node_id", "code"))
    pairs = e.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("graph_id", "src", "dst")
    for s in SIDES:
        keyed = pairs.withColumnRenamed(s, "node_id")
        pairs = lookup_join(keyed, ids.withColumnRenamed("code", f"{s}_code"), ["graph_id", "node_id"], "inner", hot_keys(e.select("graph_id", F.col(s).alias("node_id")), ["graph_id", "node_id"])).drop("node_id")
    pairs = pairs.select("src_code", "dst_code").distinct()
    each = pairs.select(F.explode(F.array(*[F.struct(F.lit(i).alias("grp"), F.col(f"{s}_code").alias("code")) for i, s in enumerate(SIDES)])).alias("x")).select("x.*")
    peers = dense_counts(each).join(codes, "code").select(F.when(F.col("grp") == 0, "src").otherwise("dst").alias("side"), "fqn", F.col("n").alias("n_peers"))
    n = _counts(e, nodes).withColumnRenamed("n", "n_edges")
    return n.join(peers, ["side", "fqn"], "left").select("side", "fqn", "n_edges", F.coalesce("n_peers", F.lit(0)).alias("n_peers"))
