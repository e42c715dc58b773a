"""Differences between the snapshots of code graphs: nodes by fqn, edges by the fqns of their ends and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CONDITIONS, CONFIDENCES, EDGE_KINDS
from ..session import cut
from .skew import hot_keys, lookup_join
from .snapshots import Ordinals, blocks_for, chunk_bits, diff_blocks, fingerprint, snapshot_order, tagged


def changes(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, ordinals: Ordinals | None = None) -> DataFrame:
    """(graph_id, record_type, fqn, dst_fqn, edge_kind, change_type) between consecutive snapshots of each repository.

    Exact duplicates count once. Rows whose graph_id is in no series, nodes without node_id or fqn, edges without src, dst or
    kind, and edges to nodes that are missing are left out. Other columns are ignored. Empty tables give an empty result. ordinals: a stored
    table of (series, fqn), which new symbols are added to; without one a table is made for this run. An edge's key is made of its ends' ordinals.
    """
    order = snapshot_order(graphs)
    last = order.groupBy("repo").agg(F.max("seq").alias("last"), F.min("graph_id").alias("series"))
    order = cut(order.join(last, "repo").withColumn("final", F.col("seq") == F.col("last")).drop("last"))
    marked = nodes.where(F.col("graph_id").isNotNull() & F.col("node_id").isNotNull() & F.col("fqn").isNotNull()).select(
        "graph_id", "node_id", "fqn",
        fingerprint(F.col("visibility"), F.col("is_abstract"), F.col("entrypoint_kind"), F.to_json("signature", {"ignoreNullFields": "false"})).alias("mark"),
    )
    known = cut(marked.join(order, "graph_id"))
    node_rows, edge_rows = known.count(), edges.count()
    # the ordinal of a symbol is the same in all snapshots: it belongs to (series, fqn)
    names = (ordinals or Ordinals(nodes.sparkSession, ["series", "fqn"], blocks_for(node_rows))).extend(known)
    numbered = cut(known.join(names, ["series", "fqn"]).drop("repo", "fqn"), drop=known)
    node_diff = diff_blocks(numbered, "series", ["ord"], F.shiftright("ord", chunk_bits(node_rows, names.count())))

    # the three values are small enumerations: together they make a small number, which travels well; others are hashed
    code = lambda c, values: F.when(F.col(c).isNull(), 0).otherwise(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)))
    told = (F.col("condition").isNull() | F.col("condition").isin(*CONDITIONS)) & (F.col("confidence").isNull() | F.col("confidence").isin(*CONFIDENCES)) & (F.col("tier").isNull() | F.col("tier").between(0, 99))
    small_mark = (code("condition", CONDITIONS) * 10 + code("confidence", CONFIDENCES)) * 1000 + F.coalesce(F.col("tier").cast("long") + 1, F.lit(0))
    value = F.when(F.coalesce(told, F.lit(False)), small_mark).otherwise(F.xxhash64(tagged(F.col("condition"), F.col("confidence"), F.col("tier"))))
    # the enumeration's kinds are coded by their place, others by a hash that is looked up again for what changed
    place = F.array_position(F.array(*[F.lit(k) for k in EDGE_KINDS]), F.col("kind"))
    kind = F.when(place > 0, place).otherwise(F.xxhash64("kind"))
    plain = edges.where(F.col("graph_id").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("kind").isNotNull())
    small = plain.select("graph_id", "src", "dst", kind.alias("kind_code"), value.alias("mark"))
    ends = numbered.select("graph_id", "node_id", "ord").distinct()
    by_src = lookup_join(small.withColumnRenamed("src", "node_id"), ends.withColumnRenamed("ord", "src_ord"), ["graph_id", "node_id"], "inner", hot_keys(plain.select("graph_id", F.col("src").alias("node_id")), ["graph_id", "node_id"]))
    by_src = by_src.drop("node_id").withColumnRenamed("dst", "node_id")
    by_dst = lookup_join(by_src, ends.withColumnRenamed("ord", "dst_ord"), ["graph_id", "node_id"], "inner", hot_keys(plain.select("graph_id", F.col("dst").alias("node_id")), ["graph_id", "node_id"])).drop("node_id")
    ready = by_dst.join(order.select("graph_id", "series", "seq", "final"), "graph_id")
    edge_diff = diff_blocks(ready, "series", ["src_ord", "dst_ord", "kind_code"], F.pmod(F.xxhash64("series", "src_ord", "dst_ord", "kind_code"), F.lit(blocks_for(edge_rows))).cast("int"))

    later = order.select("series", "seq", "graph_id")
    n = node_diff.join(names, ["series", "ord"]).join(later, ["series", "seq"])
    n = n.select("graph_id", F.lit("node").alias("record_type"), "fqn", F.lit("").alias("dst_fqn"), F.lit("").alias("edge_kind"), F.col("change").alias("change_type"))
    other = plain.where(place == 0).select(kind.alias("kind_code"), F.col("kind").alias("other")).distinct()
    e = edge_diff.join(later, ["series", "seq"]).join(other, "kind_code", "left")
    e = e.join(names.select("series", F.col("ord").alias("src_ord"), "fqn"), ["series", "src_ord"])
    e = e.join(names.select("series", F.col("ord").alias("dst_ord"), F.col("fqn").alias("dst_fqn")), ["series", "dst_ord"])
    e = e.select("graph_id", F.lit("edge").alias("record_type"), "fqn", "dst_fqn", F.coalesce("other", F.get(F.array(*[F.lit(k) for k in EDGE_KINDS]), (F.col("kind_code") - 1).cast("int"))).alias("edge_kind"), F.col("change").alias("change_type"))
    return n.unionByName(e)
