"""Strongly connected components of a graph, and the order in which they depend on each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard
from .skew import hot_keys, lookup_join


def _spread(steps: DataFrame, colors: DataFrame, hot: list[tuple]) -> DataFrame:
    """(node, color): the greatest color that reaches a node along steps (node, peer). Only
    what changed in a round is followed in the next."""
    front = colors
    while True:
        offered = lookup_join(steps, front, ["node"], "inner", hot).groupBy(F.col("peer").alias("node")).agg(F.max("color").alias("offer"))
        changed = cut(colors.join(offered, "node").where(F.col("offer") > F.col("color")).select("node", F.col("offer").alias("color")))
        if changed.isEmpty():
            discard(changed)
            return colors
        colors = cut(colors.join(changed.withColumnRenamed("color", "new"), "node", "left").select("node", F.coalesce("new", "color").alias("color")))
        front = changed


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component, size): each node's strongly connected component, named by its least node.

    edges: (src, dst) of long ids; nodes (nid), if given, add nodes without edges. Each round the nodes that nothing leads to, or that lead nowhere, are
    components of their own; among the rest the greatest id is spread forward as a color, and what leads back to a color's node within the color is
    one component. Rows with nulls are dropped, repeated rows and loops change nothing, an empty graph gives an empty result.
    """
    e = cut(edges.select("src", "dst").dropna().where("src <> dst").distinct())
    every = e.select(F.explode(F.array("src", "dst")).alias("node"))
    every = cut((every if nodes is None else every.unionByName(nodes.select(F.col("nid").alias("node")).dropna())).distinct())
    left, found = every, []
    while True:
        # what lies on a circle has an edge in and one out, among what is left; peel until that holds for all
        while True:
            inner = left.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").join(e.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
            inner = cut(inner)
            if inner.count() == left.count():
                break
            found.append(cut(left.join(inner, "node", "left_anti").select("node", F.col("node").alias("component"))))
            left = inner
            e = cut(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        if left.isEmpty():
            break
        steps = e.select(F.col("src").alias("node"), F.col("dst").alias("peer"))
        color = _spread(steps, left.select("node", F.col("node").alias("color")), hot_keys(steps, ["node"]))
        # backward from the node that gave its name to a color, within the color
        at = e.join(color.withColumnRenamed("node", "src").withColumnRenamed("color", "c"), "src").join(color.withColumnRenamed("node", "dst").withColumnRenamed("color", "d"), "dst").where("c = d")
        back = cut(at.select(F.col("dst").alias("node"), F.col("src").alias("peer")))
        start = color.select("node", F.when(F.col("node") == F.col("color"), 1).otherwise(0).alias("color"))
        marked = _spread(back, start, hot_keys(back, ["node"])).where("color = 1").select("node")
        one = color.join(marked, "node").select("node", "color")
        name = one.groupBy("color").agg(F.min("node").alias("component"))
        done = cut(one.join(name, "color").select("node", "component"))
        found.append(done)
        left = cut(left.join(done.select("node"), "node", "left_anti"))
        e = cut(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    if not found:
        return every.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    out = reduce(DataFrame.unionByName, found)
    return out.join(out.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", "component", "size")


def layers(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, layer): 0 for components that lead to no other, else one more than the highest they lead to; so ascending layers are a reversed
    topological order. parts is what components() gives."""
    of = parts.select("node", "component")
    e = edges.select("src", "dst").dropna().join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    e = cut(e.where("a <> b").select("a", "b").distinct())
    left, layer, out = cut(of.select("component").distinct()), 0, []
    while not left.isEmpty():
        now = cut(left.join(e.select(F.col("a").alias("component")).distinct(), "component", "left_anti"))
        out.append(now.withColumn("layer", F.lit(layer)))
        left = cut(left.join(now, "component", "left_anti"), drop=left)
        e = cut(e.join(now.withColumnRenamed("component", "b"), "b", "left_anti"), drop=e)
        layer += 1
    return reduce(DataFrame.unionByName, out) if out else left.withColumn("layer", F.lit(0))
