"""Walks over edges, level by level, for any number of roots at once.

Every level is a join of the frontier with the edges, reduced to one row per (root, node) with map-side minima. Where the edge of discovery
matters, the least path of node ids decides: this is what a queue that is filled in order of ids would find, without any order between
tasks. A round puts HOPS levels into one plan: what a level finds again is outdone by its own shorter path when the round is reduced, so levels
of a round need no driver between them, and a walk of at most HOPS steps is one lazy plan. Longer walks write the admitted steps once, as a
narrow table, and each round's result to the shared folder: no lineage grows and nothing is lost with an executor. The steps of nodes
that hold a large share of all steps are split over salted parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CONFIDENCES, EXCEPTIONAL
from ..session import cut, discard, together
from .skew import hot_keys, lookup_join

#: Levels of a round.
HOPS = 4
FOUND = ("root", "node", "depth", "path", "edges", "raised", "conf", "condition", "confidence")


def oriented(edges: DataFrame, forward: bool = True) -> DataFrame:
    """(node, peer, edge, spawns, raises, conf, condition, confidence): edges as steps in the direction of the walk."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    rank = "case confidence " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(CONFIDENCES) if i) + " else 0 end"
    raises = ", ".join(f"'{c}'" for c in EXCEPTIONAL)
    return edges.selectExpr(f"{a} as node", f"{b} as peer", "eid as edge", "kind = 'spawns' as spawns", f"condition in ({raises}) as raises", f"{rank} as conf", "condition", "confidence")


def _all(layers: list[DataFrame], *columns: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in layers] if columns else layers)


def _next(front: DataFrame, steps: DataFrame, hot: list[tuple]) -> DataFrame:
    """front joined to its steps. A small frontier is sent to the steps wherever they lie; else the steps of hot nodes are split over parts, with
    the frontier's rows at these nodes in each part."""
    return lookup_join(steps, front, ["node"], "inner", hot)


def _prepared(steps: DataFrame, most: int | None) -> tuple[DataFrame, list[tuple]]:
    """The steps as a table of their own with its hot nodes, if the walk takes more than one round."""
    if most is not None and most <= HOPS:
        return steps, []
    steps = cut(steps)
    return steps, hot_keys(steps, ["node"])


def _best(found: DataFrame, *rank: str) -> DataFrame:
    """One row per (root, node): the least by `rank` and then by path and edges."""
    rest = [c for c in FOUND if c not in ("root", "node", *rank)]
    return found.groupBy("root", "node").agg(F.expr(f"min(struct({', '.join((*rank, *rest))})) as x")).select("root", "node", *[f"x.{c}" for c in FOUND[2:]])


def bfs(steps: DataFrame, seeds: DataFrame, max_depth: int | None = None, goals: DataFrame | None = None) -> DataFrame:
    """(root, node, depth, path, edges, raised, conf, condition, confidence) of what seeds (root, node) reach, each once at its least depth; seeds themselves
    are left out.

    path and edges lead from the seed to the node by the walk's own tree; raised tells whether an exceptional edge was crossed since the last spawn,
    conf is the least confidence on that path, condition and confidence are those of the last edge. With goals (root, node) a root is followed no
    further once all of its goals are met. Repeated steps change nothing.
    """
    steps, hot = _prepared(steps, max_depth)
    start = seeds.select("root", "node").distinct().selectExpr("root", "node", "0 as depth", "array(node) as path", "cast(array() as array<bigint>) as edges", "false as raised", "2 as conf", "cast(null as string) as condition", "cast(null as string) as confidence")
    one_round = max_depth is not None and max_depth <= HOPS
    front = start if one_round else cut(start)
    layers, depth = [front], 0
    while max_depth is None or depth < max_depth:
        here, levels = front, []
        for depth in range(depth + 1, depth + 1 + (HOPS if max_depth is None else min(HOPS, max_depth - depth))):
            at = here.withColumnRenamed("conf", "front_conf").drop("condition", "confidence")
            found = _next(at, steps, hot).where("not array_contains(path, peer)").selectExpr(
                "root", "peer as node", f"{depth} as depth", "path", "struct(edge, edges) as edges", "not spawns and (raised or raises) as raised", "least(front_conf, conf) as conf", "condition", "confidence"
            )
            if not one_round:
                found = found.join(together(layers).select("root", "node"), ["root", "node"], "left_anti")
            here = _best(found).selectExpr("root", "node", "depth", "concat(path, array(node)) as path", "concat(edges.edges, array(edges.edge)) as edges", *FOUND[5:])
            levels.append(here)
        if one_round:  # seeds stand at depth 0 and outdo what leads back to them
            return _best(_all([start, *levels]), "depth").where(F.col("depth") > 0)
        new = cut(levels[0] if len(levels) == 1 else _best(_all(levels), "depth"))
        if new.isEmpty():
            discard(new)
            break
        layers.append(new)
        front = new.where(F.col("depth") == depth)
        if goals is not None:
            left = cut(goals.select("root", "node").distinct().join(together(layers).select("root", "node"), ["root", "node"], "left_anti").select("root").distinct())
            if left.isEmpty():
                break
            front = front.join(left, "root", "left_semi")
    return together(layers[1:]) if len(layers) > 1 else front.where(F.lit(False))


def reached(steps: DataFrame, seeds: DataFrame, by_root: bool = False, most: int | None = None) -> DataFrame:
    """(node) or (root, node): all that seeds reach by any number of steps, or by up to `most`, seeds included."""
    key = ["root", "node"] if by_root else ["node"]
    thin, hot = _prepared(steps.select("node", "peer"), most)
    one_round = most is not None and most <= HOPS
    front = seeds.select(*key).distinct()
    front = front if one_round else cut(front)
    layers, hops = [front], 0
    while most is None or hops < most:
        here, levels = front, []
        for _ in range(HOPS if most is None else min(HOPS, most - hops)):
            hops += 1
            here = _next(here, thin, hot).select(*key[:-1], F.col("peer").alias("node")).distinct()
            if not one_round:
                here = here.join(together(layers), key, "left_anti")
            levels.append(here)
        if one_round:
            return _all([front, *levels]).distinct()
        new = cut(_all(levels).distinct())
        if new.isEmpty():
            discard(new)
            break
        layers.append(new)
        front = new
    return together(layers)


def within(steps: DataFrame, seeds: DataFrame, least: int = 1, most: int = 8) -> DataFrame:
    """(root, node): nodes that a walk of `least` to `most` steps reaches; nodes and edges may repeat, so a root may reach itself.

    A walk of no step yields nothing, so least 0 is as 1. Each level is a set; no visited set is taken off, which would lose circles.
    """
    thin, hot = _prepared(steps.select("node", "peer"), most)
    one_round = most <= HOPS
    front = seeds.select("root", "node").distinct()
    front = front if one_round else cut(front)
    none, found, hops = front.where(F.lit(False)), [], 0
    while hops < most:
        here, levels = front, []
        for _ in range(min(HOPS, most - hops)):
            hops += 1
            here = _next(here, thin, hot).select("root", F.col("peer").alias("node")).distinct()
            levels.append(here.withColumn("hop", F.lit(hops)))
        new = _all(levels)
        if not one_round:
            new = cut(new)
            if new.isEmpty():
                break
        found.append(new.where(F.col("hop") >= max(least, 1)).select("root", "node"))
        front = new.where(F.col("hop") == hops).select("root", "node")
    return _all(found).distinct() if found else none


def paths(steps: DataFrame, seeds: DataFrame, goals: DataFrame | None, least: int = 1, most: int | None = 6, trails: bool = False) -> DataFrame:
    """(root, node, hops, path, edges, raised): every simple path (no node twice) or trail (no edge twice) of `least` to `most` steps from
    the seeds to goals (root, node) or, for every root, (node), or to any node if goals is None.

    A path to a goal ends where it first meets that goal; a trail may come back to its root. Without `most` the walk ends by itself,
    as no node or edge repeats.
    """
    steps, hot = _prepared(steps.select("node", "peer", "edge", "spawns", "raises").distinct(), most)
    one_round = most is not None and most <= HOPS
    front = seeds.select("root", "node").distinct().select("root", "node", F.lit(0).alias("hops"), F.array("node").alias("path"), F.array().cast("array<bigint>").alias("edges"), F.lit(False).alias("raised"), F.lit(False).alias("first"))
    at = ["root", "node"] if goals is not None and "root" in goals.columns else ["node"]
    out, k = [], 0
    while most is None or k < most:
        here, levels = front, []
        for k in range(k + 1, k + 1 + (HOPS if most is None else min(HOPS, most - k))):
            fresh = ~F.array_contains("edges", F.col("edge")) if trails else ~F.array_contains("path", F.col("peer"))
            first = ~F.array_contains(F.slice("path", 2, k), F.col("peer"))
            here = _next(here.drop("hops", "first").withColumnRenamed("raised", "was"), steps, hot).where(fresh).select(
                "root", F.col("peer").alias("node"), F.lit(k).alias("hops"), F.concat("path", F.array("peer")).alias("path"), F.concat("edges", F.array("edge")).alias("edges"), F.when(F.col("spawns"), False).otherwise(F.col("was") | F.col("raises")).alias("raised"), first.alias("first")
            )
            levels.append(here)
        new = _all(levels)
        if not one_round:
            new = cut(new)
            if new.isEmpty():
                break
        out.append(new)
        front = new.where(F.col("hops") == k)
    if not out:
        return front.select("root", "node", "hops", "path", "edges", "raised").where(F.lit(False))
    found = _all(out).where(F.col("first") & (F.col("hops") >= max(least, 1)))
    found = found if goals is None else found.join(goals.select(*at).distinct(), at, "left_semi")
    return found.select("root", "node", "hops", "path", "edges", "raised")


def capped(found: DataFrame, keys: list[str], order: list[Column], cap: int | None) -> DataFrame:
    """The first `cap` rows of each key in the given order; all without a cap. A report's limit, not a way to spare work."""
    if cap is None:
        return found
    from pyspark.sql import Window as W

    return found.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")
