"""Parent-child rows to full hierarchies: depth, root, path and descendants of each node, and circles.

Frontier joins run level by level from the roots, but STRIDE levels at a time: first each child learns its next STRIDE
ancestors (three self-joins), then a frontier of STRIDE levels settles, per round, all nodes whose STRIDE-th ancestor lies in it.
Nodes that no round reaches lie on a circle or below one; pointer doubling over these finds the circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard
from .skew import HOT_FLOOR, HOT_SHARE, hot_keys, lookup_join

STRIDE = 8


def links(edges: DataFrame, group: str = "graph_id", parent: str = "src", child: str = "dst") -> DataFrame:
    """(g, node, parent), one row per child. Rows with a null are dropped; of several parents of a child the smallest counts."""
    return (
        edges.where(F.col(group).isNotNull() & F.col(parent).isNotNull() & F.col(child).isNotNull())
        .select(F.col(group).alias("g"), F.col(child).alias("node"), F.col(parent).alias("parent"))
        .groupBy("g", "node")
        .agg(F.min("parent").alias("parent"))
    )


def _ancestors(up: DataFrame) -> DataFrame:
    """(g, node, up: the next 1 to STRIDE ancestors, nearest first). Fewer than STRIDE: the last one is a root."""
    up = cut(up.select("g", "node", F.array("parent").alias("up")))
    n = 1
    while n < STRIDE:
        keyed = up.withColumn("__top", F.when(F.size("up") == n, F.element_at("up", -1)))
        above = up.select("g", F.col("node").alias("__top"), F.col("up").alias("__more"))
        joined = lookup_join(keyed, above, ["g", "__top"], "left", hot_keys(keyed, ["g", "__top"]))
        up = cut(joined.select("g", "node", F.when(F.col("__more").isNull(), F.col("up")).otherwise(F.concat("up", "__more")).alias("up")), drop=up)
        n *= 2
    return up


def settle(up_links: DataFrame, paths: bool) -> tuple[list[DataFrame], DataFrame]:
    """Frontiers (g, node, depth, root[, path]) of all reached children, and the rest (g, node, up) that is never reached.

    With paths, `path` is the array of ids from the root down to the node.
    """
    up = _ancestors(up_links)
    short = F.size("up") < STRIDE
    cols = [F.size("up").alias("depth"), F.element_at("up", -1).alias("root")]
    if paths:
        cols.append(F.concat(F.reverse("up"), F.array("node")).alias("path"))
    front = cut(up.where(short).select("g", "node", *cols))
    done, rest = [front], cut(up.where(~short), drop=up)
    # the STRIDE-th ancestor may be a root itself: roots are the depth-0 part of the first frontier
    top = F.element_at("up", -1).alias("__top")
    first = True
    while True:
        keyed = rest.select("g", "node", "up", top)
        mark = front.select("g", F.col("node").alias("__top"), "depth", "root", *(["path"] if paths else []))
        if first:
            # a top that is nobody's child is a root
            tops = keyed.select("g", "__top").distinct()
            roots = tops.join(up_links.select("g", F.col("node").alias("__top")), ["g", "__top"], "left_anti")
            mark = mark.unionByName(roots.select("g", "__top", F.lit(0).alias("depth"), F.col("__top").alias("root"), *([F.array("__top").alias("path")] if paths else [])))
            first = False
        hit = lookup_join(keyed, mark, ["g", "__top"], "left", hot_keys(keyed, ["g", "__top"]))
        both = cut(hit)
        new = both.where(F.col("depth").isNotNull())
        cols = [(F.col("depth") + STRIDE).alias("depth"), "root"]
        if paths:
            cols.append(F.concat("path", F.reverse(F.slice("up", 1, STRIDE - 1)), F.array("node")).alias("path"))
        front = cut(new.select("g", "node", *cols))
        if front.isEmpty():
            discard(front)
            discard(both)
            return done, rest
        done.append(front)
        rest = cut(both.where(F.col("depth").isNull()).select("g", "node", "up"), drop=rest)
        discard(both)


def circles(rest: DataFrame) -> DataFrame:
    """(g, node, cycle): of each node that is never reached, the smallest node id on its circle.

    rest: (g, node, up), the unreached nodes with their next STRIDE ancestors. Pointers double until the set they point at stops
    shrinking (then all of it is on circles) and no minimum along the way changes.
    """
    cur = cut(rest.select("g", "node", F.element_at("up", -1).alias("to"), F.array_min("up").alias("low")))
    before = None
    while True:
        by = cur.groupBy("g", "to").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
        at = by.agg(F.count(F.lit(1)).alias("targets"), F.sum("low").cast("string").alias("lows"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
        if before == (at["targets"], at["lows"]) or not at["targets"]:
            break
        before = (at["targets"], at["lows"])
        hot = hot_keys(cur, ["g", "to"]) if at["most"] >= max(HOT_FLOOR, at["n"] * HOT_SHARE) else []
        nxt = cur.select("g", F.col("node").alias("to"), F.col("to").alias("__to"), F.col("low").alias("__low"))
        step = lookup_join(cur, nxt, ["g", "to"], "inner", hot)
        cur = cut(step.select("g", "node", F.col("__to").alias("to"), F.least("low", "__low").alias("low")), drop=cur)
    low = cur.select("g", F.col("node").alias("to"), F.col("low").alias("cycle"))
    hot = hot_keys(cur, ["g", "to"])
    return lookup_join(cur.select("g", "node", "to"), low, ["g", "to"], "inner", hot).select("g", "node", "cycle")


def cycle_members(edges: DataFrame, group: str = "graph_id", parent: str = "src", child: str = "dst") -> DataFrame:
    """(g, node, cycle) of the nodes whose chain of parents never ends.

    Repeated rows count once, rows with nulls are dropped, other columns are ignored; an empty input gives an empty result.
    """
    done, rest = settle(cut(links(edges, group, parent, child)), paths=False)
    for x in done:
        discard(x)
    return circles(rest)


def hierarchy(edges: DataFrame, nodes: DataFrame | None = None, group: str = "graph_id", parent: str = "src", child: str = "dst", node: str = "node_id") -> DataFrame:
    """(g, node, depth, root, path, cycle) of each node in `edges` and, if given, of each in `nodes`.

    path is the array of ids from the root to the node. Nodes whose chain never ends have depth, root and path null and `cycle`
    set; all others have `cycle` null. A node without parent is a root of depth 0, also if it has no child. Nulls are dropped,
    repeated rows count once.
    """
    up = cut(links(edges, group, parent, child))
    done, rest = settle(up, paths=True)
    reached = done[0]
    for x in done[1:]:
        reached = reached.unionByName(x)
    every = up.select("g", F.col("parent").alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select(F.col(group).alias("g"), F.col(node).alias("node")))
    every = every.where(F.col("g").isNotNull() & F.col("node").isNotNull()).distinct()
    none = F.lit(None)
    roots = every.join(up, ["g", "node"], "left_anti").select("g", "node", F.lit(0).alias("depth"), F.col("node").alias("root"), F.array("node").alias("path"), none.cast(up.schema["node"].dataType).alias("cycle"))
    lost = circles(rest).select("g", "node", none.cast("int").alias("depth"), none.cast(up.schema["node"].dataType).alias("root"), none.cast(roots.schema["path"].dataType).alias("path"), "cycle")
    return reached.withColumn("cycle", none.cast(up.schema["node"].dataType)).unionByName(roots).unionByName(lost)


def descendants(tree: DataFrame) -> DataFrame:
    """(g, ancestor, node, distance) for each pair of a result of hierarchy(): a node is no descendant of itself."""
    pairs = tree.where(F.size("path") > 1).select("g", "node", "depth", F.posexplode(F.slice(F.col("path"), F.lit(1), F.size("path") - 1)).alias("level", "ancestor"))
    return pairs.select("g", "ancestor", "node", (F.col("depth") - F.col("level")).alias("distance"))
