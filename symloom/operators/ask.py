"""The named questions about a code graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import kind_of, matches
from ..functions.selector import cross_language, select
from ..graph import CodeGraph, token
from ..model import CALL_FAMILY, CONFIDENCES, CUT_MARKERS
from ..session import cut
from . import walk
from .filters import EdgeFilter

#: Data-flow edges.
FLOW = EdgeFilter(kinds=("derives-from",))
NODE = ("nid", "graph_id", "fqn", "kind", "file", "line_start")


def seeds(g: CodeGraph, pattern: str) -> DataFrame:
    """(root, node): the nodes a pattern names, each its own root."""
    return g.raw_nodes.where(matches(pattern, F.col("fqn"))).select(F.col("nid").alias("root"), F.col("nid").alias("node")).distinct()


def resolve_one(g: CodeGraph, pattern: str) -> DataFrame:
    """(root, node) of the first match by id in each graph, as a query with one subject takes it."""
    return g.raw_nodes.where(matches(pattern, F.col("fqn"))).groupBy("graph_id").agg(F.min("nid").alias("root")).select("root", F.col("root").alias("node"))


class NotFound(ValueError):
    """No node has the name asked for."""


class Ambiguous(ValueError):
    """A full name that several nodes of one graph have."""


def anchor(g: CodeGraph, pattern: str) -> DataFrame:
    """resolve_one where a unique subject is required: NotFound if nothing matches, Ambiguous if a full name has several nodes in a graph; of a pattern's or
    a short name's matches the first by id is taken."""
    hits = g.raw_nodes.where(matches(pattern, F.col("fqn"))).groupBy("graph_id").agg(F.min("nid").alias("root"), F.max("nid").alias("last"))
    told = hits.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("root") < F.col("last")).alias("several")).first()
    if not told["n"]:
        raise NotFound(f"nothing is named {pattern}")
    if told["several"] and kind_of(pattern) == "fqn":
        raise Ambiguous(f"{pattern} names several nodes in {told['several']} graphs")
    return hits.select("root", F.col("root").alias("node"))


def _described(g: CodeGraph, found: DataFrame, *keys: str) -> DataFrame:
    """found with what is asked of its nodes. Duplicates of nodes go after the join, when few are left; keys name a row of found."""
    x = found.join(g.raw_nodes.select(*NODE).withColumnRenamed("nid", "node"), "node")
    return x if g.unique else x.dropDuplicates(list(keys))


def neighbors(g: CodeGraph, subject: DataFrame, forward: bool, depth: int | None = 2, admit: EdgeFilter = EdgeFilter()) -> DataFrame:
    """Callees (forward) or callers of subject (root, node): one row per node reached, with the edge of discovery.

    Columns: root, nid, graph_id, fqn, kind, file, line_start, depth, via, condition, confidence, min_confidence, raised. The subject is never in the
    answer, so direct recursion doesn't show.
    """
    found = walk.bfs(walk.oriented(admit.raw(g), forward), subject, depth)
    x = _described(g, found, "root", "node").withColumn("via", F.element_at("edges", -1))
    return x.select("root", F.col("node").alias("nid"), "graph_id", "fqn", "kind", "file", "line_start", "depth", "via", "condition", "confidence", token(F.col("conf"), CONFIDENCES).alias("min_confidence"), "raised")


def callers(g: CodeGraph, pattern: str, depth: int | None = 2, admit: EdgeFilter = EdgeFilter()) -> DataFrame:
    return neighbors(g, resolve_one(g, pattern), False, depth, admit)


def callees(g: CodeGraph, pattern: str, depth: int | None = 2, admit: EdgeFilter = EdgeFilter()) -> DataFrame:
    return neighbors(g, resolve_one(g, pattern), True, depth, admit)


def flows_from(g: CodeGraph, pattern: str, depth: int | None = 2) -> DataFrame:
    """What the subject's value derives from: data-flow edges run from the derived value to its source."""
    return neighbors(g, resolve_one(g, pattern), True, depth, FLOW)


def flows_to(g: CodeGraph, pattern: str, depth: int | None = 2) -> DataFrame:
    return neighbors(g, resolve_one(g, pattern), False, depth, FLOW)


def neighborhood(g: CodeGraph, pattern: str, forward: bool = True, depth: int | None = 2, admit: EdgeFilter = EdgeFilter()) -> DataFrame:
    """(root, src, dst, eid): all admitted edges among the subject and what it reaches, in the direction of the walk."""
    subject = resolve_one(g, pattern)
    steps = walk.oriented(admit.raw(g), forward)
    nodes = cut(walk.bfs(steps, subject, depth).select("root", "node").unionByName(subject))
    inner = steps.select("node", "peer", "edge").join(nodes, "node").join(nodes.withColumnRenamed("node", "peer"), ["root", "peer"], "left_semi")
    inner = inner.select("root", F.col("node").alias("src"), F.col("peer").alias("dst"), F.col("edge").alias("eid"))
    return inner if g.unique else inner.distinct()


def reaches(g: CodeGraph, source: str, target: str, depth: int | None = None, admit: EdgeFilter = EdgeFilter()) -> DataFrame:
    """(root, node, depth, path, edges): a shortest witness per graph in which the first match of source reaches that of target.

    A subject reaches itself by the path of one node.
    """
    goals = _goals(g, source, target)
    found = walk.bfs(walk.oriented(admit.raw(g)), goals.select("root", F.col("root").alias("node")), depth, goals)
    hit = found.join(goals, ["root", "node"], "left_semi").select("root", "node", "depth", "path", "edges")
    same = goals.where(F.col("root") == F.col("node")).select("root", "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.array().cast("array<bigint>").alias("edges"))
    return hit.unionByName(same)


def simple_paths(g: CodeGraph, source: str, target: str, depth: int | None = 6, admit: EdgeFilter = EdgeFilter(), cap: int | None = 1024) -> DataFrame:
    """(root, node, hops, path, edges, raised): simple paths from the first match of source to that of target, per graph.

    The first `cap` in order of their nodes and edges are given, as a report of paths does; cap None gives all. From a node to itself
    there is none.
    """
    goals = _goals(g, source, target)
    near = _towards(walk.oriented(admit.raw(g)), goals, depth)
    found = walk.paths(near, goals.select("root", F.col("root").alias("node")), goals, 1, depth)
    interleaved = F.flatten(F.zip_with(F.slice(F.col("path"), F.lit(2), F.size("edges")), F.col("edges"), lambda n, e: F.array(n, e)))
    return walk.capped(found.withColumn("__o", interleaved), ["root", "node"], [F.col("__o")], cap).drop("__o")


def _goals(g: CodeGraph, source: str, target: str) -> DataFrame:
    """(root, node): the first match of source and that of target, in each graph that has both."""
    a, b = resolve_one(g, source), resolve_one(g, target)
    return cut(a.select(F.shiftright("root", 32).alias("g"), "root").join(b.select(F.shiftright("root", 32).alias("g"), "node"), "g").select("root", "node"))


def _towards(steps: DataFrame, goals: DataFrame, depth: int | None) -> DataFrame:
    """Steps that can still lead to a goal: what walks backward from the goals within depth finds. It changes no path, only what is tried."""
    back = steps.select(F.col("peer").alias("node"), F.col("node").alias("peer"))
    near = walk.reached(back, goals, most=None if depth is None else depth - 1)
    return cut(steps.join(near.withColumnRenamed("node", "peer"), "peer", "left_semi"))


def entrypoints(g: CodeGraph) -> DataFrame:
    return g.raw_nodes.where(F.col("entrypoint_kind").isNotNull()).select("nid")


def unused(g: CodeGraph, roots: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Nodes no root reaches over the call family. roots (nid), by default all entry points; kinds limits what is reported."""
    roots = entrypoints(g) if roots is None else roots
    live = walk.reached(walk.oriented(EdgeFilter().raw(g)), roots.select(F.col("nid").alias("node")))
    n = g.node_rows(*NODE, where=F.col("kind").isin(*kinds) if kinds else None)
    return n.join(live.withColumnRenamed("node", "nid"), "nid", "left_anti").select(*NODE)


def explain(g: CodeGraph, pattern: str) -> DataFrame:
    """Edges next to the subject: root, direction, peer, eid, kind, condition, confidence, tier, rule. One edge, that of the least id, per peer; loops don't show."""
    subject = resolve_one(g, pattern)
    e = EdgeFilter().raw(g)  # repeated edges have the least id together
    out = []
    for name, a, b in (("caller", "dst", "src"), ("callee", "src", "dst")):
        near = e.join(subject.select(F.col("node").alias(a)), a).where(F.col("src") != F.col("dst"))
        x = near.groupBy(F.col(a).alias("root"), F.col(b).alias("peer")).agg(F.min(F.struct("eid", "kind", "condition", "confidence", "tier", "rule")).alias("x"))
        out.append(x.select("root", F.lit(name).alias("direction"), "peer", "x.*"))
    return out[0].unionByName(out[1])


def degrees(g: CodeGraph) -> DataFrame:
    """Per node its edges of the call family and of data flow: inbound, outbound, and of these calls, flows, exceptional and certain ones.

    A loop counts once each way; nodes without edges stay with zeros. Each end is counted apart with map-side sums, so a node with very
    many edges costs no single task.
    """
    e = g.edge_rows("src", "dst", "kind", "condition", "confidence", where=F.col("kind").isin(*CALL_FAMILY, "derives-from"))
    call = F.col("kind").isin(*CALL_FAMILY)
    ends = []
    for side, c in (("outbound", "src"), ("inbound", "dst")):
        ends.append(
            e.groupBy(F.col(c).alias("nid")).agg(
                F.count(F.lit(1)).alias(side), F.count_if(call).alias(f"{side}_calls"), F.count_if(~call).alias(f"{side}_flows"), F.count_if(F.col("condition").isin("exception", "panic")).alias(f"{side}_exceptional"), F.count_if(F.col("confidence") == "certain").alias(f"{side}_certain")
            )
        )
    out = g.node_rows(*NODE).join(ends[0], "nid", "left").join(ends[1], "nid", "left")
    counts = [c for c in out.columns if c.split("_")[0] in ("outbound", "inbound")]
    return out.fillna(0, counts).withColumn("total", F.col("inbound") + F.col("outbound"))


def rank(g: CodeGraph, by: str = "total", limit: int | None = 50) -> DataFrame:
    """The nodes of the highest degree: by is total, inbound or outbound; ties by name, file and line."""
    out = degrees(g).orderBy(F.desc(by), "fqn", "file", "line_start", "nid")
    return out if limit is None else out.limit(limit)


def search(g: CodeGraph, text: str, regex: bool = False, kinds: tuple[str, ...] = (), limit: int | None = 50) -> DataFrame:
    """Nodes whose name holds a text, whatever the case, or matches an expression somewhere; sorted by name, file, line."""
    if not text:
        raise ValueError("an empty search pattern matches everything")
    hit = F.col("fqn").rlike(f"(?i){text}") if regex else F.lower("fqn").contains(text.lower())
    n = g.node_rows(*NODE, where=hit & F.col("kind").isin(*kinds) if kinds else hit).orderBy("fqn", "file", "line_start", "nid")
    return n if limit is None else n.limit(limit)


def selected(g: CodeGraph, selector: str, agnostic: bool = False) -> DataFrame:
    """Nodes a selector matches, with cross_language for those of another language's syntax."""
    fqn, lang = F.col("fqn"), F.col("lang")
    flag = cross_language(selector, fqn, lang) if agnostic else F.lit(False)
    return g.node_rows(*NODE, "lang", where=select(selector, fqn, lang, agnostic)).select(*NODE, flag.alias("cross_language"))


def resolve_all(g: CodeGraph, selectors: list[str], agnostic: bool = False) -> DataFrame:
    """(selector, nid, fqn): many selectors in one pass over the nodes."""
    each = F.array(*[F.when(select(s, F.col("fqn"), F.col("lang"), agnostic), F.lit(s)) for s in selectors])
    return g.node_rows("fqn", "lang").select("nid", "fqn", F.explode(F.array_compact(each)).alias("selector"))


def nodes_of_kind(g: CodeGraph, *kinds: str) -> DataFrame:
    return g.node_rows(*NODE, where=F.col("kind").isin(*kinds)).select(*NODE)


_OWNER = r"^(.*)::\{(?:closure|func)@[^{}]*\}$"


def impacted_tests(g: CodeGraph, changed: DataFrame, tests_only: bool = True) -> DataFrame:
    """(graph_id, test, fqn, depth, path, confidence): tests from which a changed node (nid) is reached over calls.

    Callers are walked backward from all changed nodes; a closure that is reached pulls in the function that holds it, until nothing new comes.
    depth counts the steps of the shortest chain found, lifts included; path leads from the test to the changed node. A chain with a lift has the
    confidence possible, any other its weakest edge.
    """
    steps = walk.oriented(EdgeFilter().raw(g), False)
    changed = changed.select("nid").distinct()
    lambdas = g.raw_nodes.where(F.col("fqn").endswith("}")).withColumn("holder", F.regexp_extract("fqn", _OWNER, 1)).where(F.col("holder") != "")
    lambdas = lambdas.select("graph_id", F.col("nid").alias("node"), F.col("holder").alias("fqn")).distinct()
    holders = g.raw_nodes.join(lambdas.select("graph_id", "fqn").distinct(), ["graph_id", "fqn"], "left_semi").groupBy("graph_id", "fqn").agg(F.min("nid").alias("owner"))
    lifts = lambdas.join(holders, ["graph_id", "fqn"]).select("node", F.col("owner").alias("peer"))
    lift_steps = lifts.select("node", "peer", F.lit(None).cast("bigint").alias("edge"), F.lit(False).alias("spawns"), F.lit(False).alias("raises"), F.lit(0).alias("conf"), F.lit(None).cast("string").alias("condition"), F.lit(None).cast("string").alias("confidence"))
    # one root for all changed nodes: what matters is the nearest change
    one = changed.select(F.shiftright("nid", 32).alias("root"), F.col("nid").alias("node"))
    found = walk.bfs(steps.unionByName(lift_steps), one)
    own = one.select("root", "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(2).alias("conf"))
    every = found.select("root", "node", "depth", "path", "conf").unionByName(own)
    t = g.node_rows("graph_id", "fqn", where=F.col("entrypoint_kind") == "test" if tests_only else None)
    return every.join(t.withColumnRenamed("nid", "node"), "node").select("graph_id", F.col("node").alias("test"), "fqn", "depth", F.reverse("path").alias("path"), token(F.col("conf"), CONFIDENCES).alias("confidence"))


def doctor(g: CodeGraph) -> DataFrame:
    """One row per graph: counts, confidence split, rates (null without calls), cut markers, anomalies and the trust they leave."""
    calls = F.col("kind").isin(*CALL_FAMILY)
    e = g.edge_rows("graph_id", "kind", "confidence", "cut_markers").groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(calls).alias("n_calls"), *[F.count_if(calls & (F.col("confidence") == c)).alias(f"n_{c}") for c in CONFIDENCES],
        *[F.count_if(F.array_contains("cut_markers", m)).alias("cut_" + m.replace("-", "_")) for m in CUT_MARKERS],
    )
    n = g.node_rows("graph_id", "unresolved_calls", "external_calls", "narrowing").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.coalesce("unresolved_calls", F.lit(0)) + F.coalesce("external_calls", F.lit(0)) + F.coalesce("narrowing.visible_dropped_out", F.lit(0))).alias("n_dangling"))
    x = n.join(e, "graph_id", "left")
    x = x.fillna(0, [c for c in x.columns if c != "graph_id"])
    rate = lambda a, b: F.when(b > 0, a / b)
    x = x.withColumn("unresolved_rate", rate(F.col("cut_unresolved"), F.col("n_calls"))).withColumn("possible_share", rate(F.col("n_possible"), F.col("n_calls"))).withColumn("dangling_rate", rate(F.col("n_dangling"), F.col("n_calls") + F.col("n_dangling")))
    guessed = (F.col("n_calls") > 0) & (F.col("n_certain") == 0) & (F.col("n_probable") == 0)
    odd = F.array_compact(F.array(F.when(F.col("n_edges") == 0, F.lit("zero-edges")), F.when(guessed, F.lit("all-possible-confidence")), F.when(F.col("unresolved_rate") > 0.5, F.lit("high-unresolved-rate")), F.when(F.col("possible_share") > 0.85, F.lit("high-possible-share"))))
    x = x.withColumn("anomalies", F.array_join(odd, ","))
    n_odd = F.when(F.col("anomalies") == "", 0).otherwise(F.size(F.split("anomalies", ",")))
    doubtful = (n_odd > 0) | (F.coalesce("unresolved_rate", F.lit(0.0)) > 0.30) | guessed | (F.coalesce("possible_share", F.lit(0.0)) > 0.60)
    return x.withColumn("trust", F.when((F.col("n_edges") == 0) | (n_odd >= 2), "low").when(doubtful, "moderate").otherwise("high"))


def interface_map(g: CodeGraph, interface: str | None = None, type_: str | None = None, limit: int | None = 500) -> DataFrame:
    """(graph_id, type, interface): implements pairs by name."""
    n = g.raw_nodes.select("nid", "fqn")  # pairs are made distinct by name at the end
    x = g.raw_edges.where(F.col("kind") == "implements").select("graph_id", "src", "dst").distinct()
    x = x.join(n.select(F.col("nid").alias("src"), F.col("fqn").alias("type")), "src").join(n.select(F.col("nid").alias("dst"), F.col("fqn").alias("interface")), "dst")
    if interface:
        x = x.where(matches(interface, F.col("interface")))
    if type_:
        x = x.where(matches(type_, F.col("type")))
    x = x.select("graph_id", "type", "interface").distinct().orderBy("graph_id", "type", "interface")
    return x if limit is None else x.limit(limit)


def dependency_footprint(g: CodeGraph, pattern: str, depth: int = 2) -> DataFrame:
    """(root, total, direct, external): how many symbols the subject depends on within depth."""
    x = callees(g, pattern, depth)
    return x.groupBy("root").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("file") == "<external>").alias("external"))


def dump(g: CodeGraph, symbol: str | None = None) -> DataFrame:
    """Edges next to the symbols named: equal, ending in ::symbol, or holding it; all edges without one."""
    if symbol is None:
        return g.edges
    hit = (F.col("fqn") == symbol) | F.col("fqn").endswith("::" + symbol) | F.col("fqn").contains(symbol)
    ids = g.raw_nodes.where(hit).select("nid").distinct()
    e = g.raw_edges
    return e.join(ids.withColumnRenamed("nid", "src"), "src", "left_semi").unionByName(e.join(ids.withColumnRenamed("nid", "dst"), "dst", "left_semi")).distinct()


def export_edges(g: CodeGraph, cursor: int = 0, max_edges: int = 50_000, kind: str | None = None, confidence: str | None = None) -> DataFrame:
    """A chunk of edges from a cursor (an eid) on, in order of ids; the next cursor is the last eid plus one."""
    if not 1 <= max_edges <= 1_000_000:
        raise ValueError("max_edges is 1 to 1,000,000")
    e = EdgeFilter(kinds=(kind,) if kind else tuple(), confidence=confidence).apply(g) if kind else g.edges
    return e.where(F.col("eid") >= cursor).orderBy("eid").limit(max_edges)


def page(rows: DataFrame, order: list[str], offset: int = 0, size: int = 20) -> DataFrame:
    """A page of an answer; at most 200 rows."""
    if not 1 <= size <= 200:
        raise ValueError("a page has 1 to 200 rows")
    return rows.orderBy(*order).offset(offset).limit(size)


# The cards of a pack, in order, and which of them can be asked for.
CARDS = (
    ("repo-atlas", "Repo Atlas & Hotspot Map", False), ("symbol-card", "Symbol Card", False), ("blast-radius", "Blast-Radius Card", False), ("dependency-footprint", "Dependency Footprint", True),
    ("reachability", "Reachability & Paths", False), ("dead-code", "Dead-Code Inventory", False), ("entrypoints", "Entrypoint & Attack-Surface Catalog", False), ("interface-map", "Interface / Implementer Map", True),
    ("data-flow", "Data-Flow Provenance", False), ("graph-diff", "PR Call-Graph Diff", False),
)


def pack(g: CodeGraph, symbol: str | None = None) -> dict:
    """The manifest of a pack with its cards: the state of each graph, the list of cards, and the rows of those that can be asked for. A card about a
    symbol says whether the name was found, as no rows for a name that is not there prove nothing."""
    cards: dict = {"interface-map": {"rows": [r.asDict() for r in interface_map(g).collect()]}}
    if symbol is not None:
        found = not g.find(symbol).isEmpty()
        cards["dependency-footprint"] = {"symbol": symbol, "resolved": found, "rows": [r.asDict() for r in dependency_footprint(g, symbol).collect()] if found else []}
    return {"graphs": [r.asDict() for r in doctor(g).orderBy("graph_id").collect()], "card_registry": [{"token": t, "name": n, "implemented": i} for t, n, i in CARDS], "cards": cards}
