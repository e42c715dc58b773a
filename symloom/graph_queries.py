"""Queries of the graph operators over all graphs of the store, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import CodeGraph
from .operators import ask, diff, walk
from .operators.filters import EdgeFilter
from .session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Subjects of the questions: symbols every repository uses, and the ones that call most.
HUB, SINK, BOOT = "aux::text::join", "ext::rand::draw", "boot::wire_lazy"

_CALLS = "('calls','calls-virtual','calls-closure','calls-callback','calls-async','calls-indirect','spawns')"
_P = "(CAST({g} AS BIGINT) << 32) + {n}"
_BASE = f"""n AS (SELECT DISTINCT ON (graph_id, node_id) *, {_P.format(g='graph_id', n='node_id')} AS nid, regexp_extract(fqn, '([^:/]|:[^:])*$') AS short FROM nodes),
e AS (SELECT DISTINCT ON (graph_id, edge_id) * REPLACE ({_P.format(g='graph_id', n='src')} AS src, {_P.format(g='graph_id', n='dst')} AS dst), {_P.format(g='graph_id', n='edge_id')} AS eid FROM edges),
c AS (SELECT * FROM e WHERE kind IN {_CALLS})"""


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f: Callable[[CodeGraph], DataFrame]):
        QUERIES[name] = lambda spark, d: f(CodeGraph.load(spark, d))
        if sql:
            SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{_BASE}{', ' if sql.lstrip().startswith('--cte') else ' '}" + sql.replace("--cte", "", 1)
        return f

    return add


def _ids(x: DataFrame, *more: str) -> DataFrame:
    return x.select("graph_id", F.col("nid").alias("nid"), *more)


def _bfs_sql(start: str, depth: int, forward: bool, edges: str = "c", columns: str = "n.graph_id, w.nid, n.fqn, w.depth") -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"""--cte s AS (SELECT graph_id, min(nid) AS nid FROM n WHERE {start} GROUP BY graph_id),
w0 AS (SELECT nid AS root, nid, 0 AS depth FROM s UNION SELECT w0.root, x.{b}, w0.depth + 1 FROM w0 JOIN {edges} x ON x.{a} = w0.nid WHERE w0.depth < {depth}),
w AS (SELECT root, nid, min(depth) AS depth FROM w0 GROUP BY ALL)
SELECT {columns} FROM w JOIN n ON n.nid = w.nid WHERE w.nid <> w.root"""


query("callers_hub", _bfs_sql(f"fqn = '{HUB}'", 2, False), True)(lambda g: ask.callers(g, HUB).select("graph_id", "nid", "fqn", "depth"))
query("callees_boot", _bfs_sql(f"fqn = '{BOOT}'", 2, True), True)(lambda g: ask.callees(g, BOOT).select("graph_id", "nid", "fqn", "depth"))
query("callers_certain", _bfs_sql(f"fqn = '{SINK}'", 3, False, "(SELECT * FROM c WHERE confidence = 'certain' AND condition NOT IN ('exception','panic'))"), True)(
    lambda g: ask.callers(g, SINK, 3, EdgeFilter(confidence="certain", exclude=("exception", "panic"))).select("graph_id", "nid", "fqn", "depth")
)
_FLOW = "(SELECT * FROM e WHERE kind = 'derives-from')"
_FLOW_START = "nid IN (SELECT src FROM e WHERE kind = 'derives-from')"


def _flow_subjects(g: CodeGraph) -> DataFrame:
    e = g.raw_edges.where(F.col("kind") == "derives-from")
    return e.groupBy("graph_id").agg(F.min("src").alias("root")).select("root", F.col("root").alias("node"))


query("flows_from", _bfs_sql(_FLOW_START, 8, True, _FLOW), True)(lambda g: ask.neighbors(g, _flow_subjects(g), True, 8, ask.FLOW).select("graph_id", "nid", "fqn", "depth"))
query("flows_to", _bfs_sql(_FLOW_START, 8, False, _FLOW), True)(lambda g: ask.neighbors(g, _flow_subjects(g), False, 8, ask.FLOW).select("graph_id", "nid", "fqn", "depth"))
query(
    "callers_edge",
    f"""--cte s AS (SELECT graph_id, min(nid) AS nid FROM n WHERE fqn = '{SINK}' GROUP BY graph_id),
x AS (SELECT s.nid AS root, c.src AS nid, min(c.eid) AS via FROM s JOIN c ON c.dst = s.nid WHERE c.src <> s.nid GROUP BY ALL)
SELECT x.root, x.nid, x.via, c.condition, coalesce(c.confidence, 'none') AS confidence, coalesce(c.confidence, 'possible') AS min_confidence,
 CASE WHEN c.kind = 'spawns' THEN false ELSE c.condition IN ('exception', 'panic') END AS raised FROM x JOIN c ON c.eid = x.via JOIN n ON n.nid = x.nid""",
)(lambda g: ask.callers(g, SINK, 1).select("root", "nid", "via", "condition", F.coalesce("confidence", F.lit("none")).alias("confidence"), "min_confidence", "raised"))
query(
    "neighborhood_edges",
    f"""--cte s AS (SELECT graph_id, min(nid) AS nid FROM n WHERE fqn = '{SINK}' GROUP BY graph_id),
w AS (SELECT nid AS root, nid FROM s UNION SELECT s.nid, c.src FROM s JOIN c ON c.dst = s.nid)
SELECT w.root, c.dst AS src, c.src AS dst, c.eid FROM w JOIN c ON c.dst = w.nid JOIN w v ON v.root = w.root AND v.nid = c.src""",
)(lambda g: ask.neighborhood(g, SINK, False, 1))
query(
    "reaches_depth",
    f"""--cte s AS (SELECT graph_id, min(nid) AS nid FROM n WHERE fqn = '{BOOT}' GROUP BY graph_id), t AS (SELECT graph_id, min(nid) AS nid FROM n WHERE fqn = '{SINK}' GROUP BY graph_id),
w0 AS (SELECT nid AS root, nid, 0 AS depth FROM s UNION SELECT w0.root, c.dst, w0.depth + 1 FROM w0 JOIN c ON c.src = w0.nid WHERE w0.depth < 8)
SELECT w0.root, w0.nid AS node, min(w0.depth) AS depth FROM w0 JOIN t ON t.nid = w0.nid GROUP BY ALL""",
    True,
)(lambda g: ask.reaches(g, BOOT, SINK, 8).select("root", "node", "depth"))
query(
    "paths_simple",
    f"""--cte s AS (SELECT graph_id, min(nid) AS nid FROM n WHERE fqn = '{BOOT}' GROUP BY graph_id), t AS (SELECT graph_id, min(nid) AS nid FROM n WHERE fqn = '{SINK}' GROUP BY graph_id),
w AS (SELECT s.nid AS root, s.nid AS here, t.nid AS goal, 0 AS hops, [s.nid] AS path, []::BIGINT[] AS via FROM s JOIN t USING (graph_id)
 UNION ALL SELECT w.root, c.dst, w.goal, w.hops + 1, list_append(w.path, c.dst), list_append(w.via, c.eid) FROM w JOIN c ON c.src = w.here WHERE w.hops < 3 AND w.here <> w.goal AND NOT list_contains(w.path, c.dst))
SELECT root, here AS node, hops, array_to_string(path, '/') AS path, array_to_string(via, '/') AS edges FROM w WHERE here = goal AND hops > 0""",
    True,
)(lambda g: ask.simple_paths(g, BOOT, SINK, 3, cap=None).select("root", "node", "hops", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.array_join(F.col("edges").cast("array<string>"), "/").alias("edges")))
query(
    "unused_functions",
    """--cte live AS (SELECT nid FROM n WHERE entrypoint_kind IS NOT NULL UNION SELECT c.dst FROM live JOIN c ON c.src = live.nid)
SELECT n.graph_id, n.nid, n.fqn FROM n ANTI JOIN live ON live.nid = n.nid WHERE n.kind IN ('function', 'method')""",
    True,
)(lambda g: ask.unused(g, kinds=("function", "method")).select("graph_id", "nid", "fqn"))
query(
    "explain_symbol",
    f"""--cte s AS (SELECT graph_id, min(nid) AS nid FROM n WHERE fqn = '{SINK}' GROUP BY graph_id),
x AS (SELECT s.nid AS root, 'caller' AS direction, c.src AS peer, min(c.eid) AS eid FROM s JOIN c ON c.dst = s.nid AND c.src <> c.dst GROUP BY ALL UNION ALL SELECT s.nid, 'callee', c.dst, min(c.eid) FROM s JOIN c ON c.src = s.nid AND c.src <> c.dst GROUP BY ALL)
SELECT x.*, c.kind, c.tier, c.rule FROM x JOIN c ON c.eid = x.eid""",
)(lambda g: ask.explain(g, SINK).select("root", "direction", "peer", "eid", "kind", "tier", "rule"))
_DEG = """--cte o AS (SELECT src AS nid, count(*) AS n, count(*) FILTER (kind <> 'derives-from') AS calls, count(*) FILTER (condition IN ('exception', 'panic')) AS exc FROM e WHERE kind IN ({k}, 'derives-from') GROUP BY src),
i AS (SELECT dst AS nid, count(*) AS n, count(*) FILTER (confidence = 'certain') AS cert FROM e WHERE kind IN ({k}, 'derives-from') GROUP BY dst)
SELECT n.graph_id, n.nid, n.fqn, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound, coalesce(o.calls, 0) AS outbound_calls, coalesce(o.exc, 0) AS outbound_exceptional, coalesce(i.cert, 0) AS inbound_certain, coalesce(i.n, 0) + coalesce(o.n, 0) AS total
FROM n LEFT JOIN o ON o.nid = n.nid LEFT JOIN i ON i.nid = n.nid""".replace("{k}", _CALLS[1:-1])
_DEG_COLS = ("graph_id", "nid", "fqn", "inbound", "outbound", "outbound_calls", "outbound_exceptional", "inbound_certain", "total")
query("symbol_degrees", _DEG)(lambda g: ask.degrees(g).select(*_DEG_COLS))
query("symbols_top", _DEG + " ORDER BY total DESC, n.fqn, n.file, n.line_start, n.nid LIMIT 50")(lambda g: ask.rank(g).select(*_DEG_COLS))
query("search_text", "SELECT graph_id, nid, fqn FROM n WHERE contains(lower(fqn), 'cache')")(lambda g: _ids(ask.search(g, "CACHE", limit=None), "fqn"))
query("search_regex", "SELECT graph_id, nid, fqn FROM n WHERE regexp_matches(fqn, '(?i)::walk.*(lease|token)$')")(lambda g: _ids(ask.search(g, "::walk.*(lease|token)$", True, limit=None), "fqn"))
query("search_top", "SELECT graph_id, nid, fqn FROM n WHERE contains(lower(fqn), 'store') AND kind = 'function' ORDER BY fqn, file, line_start, nid LIMIT 50")(lambda g: _ids(ask.search(g, "store", kinds=("function",)), "fqn"))
query("pattern_glob", r"SELECT graph_id, nid, fqn FROM n WHERE regexp_matches(fqn, '^aux::[^:/]*::[^:/]oin$')")(lambda g: _ids(g.find("aux::*::?oin"), "fqn"))
query("pattern_globstar", r"SELECT graph_id, nid, fqn FROM n WHERE regexp_matches(fqn, '^[\s\S]*::store::[\s\S]*cursor$')")(lambda g: _ids(g.find("**::store::**cursor"), "fqn"))
query("pattern_short", "SELECT graph_id, nid, fqn FROM n WHERE string_split(fqn, '::')[-1] = 'join'")(lambda g: _ids(g.find("join"), "fqn"))
query("pattern_fqn", f"SELECT graph_id, nid, fqn FROM n WHERE fqn = '{HUB}'")(lambda g: _ids(g.find(HUB), "fqn"))
_LANG = "(CASE lower(trim(lang)) WHEN 'golang' THEN 'go' WHEN 'py' THEN 'python' WHEN 'python3' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'c++' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'rs' THEN 'rust' ELSE lower(trim(lang)) END)"
query("selector_affix", f"SELECT graph_id, nid, fqn FROM n, (SELECT 1) WHERE len(string_split(fqn, '::')) >= 2 AND starts_with(string_split(fqn, '::')[-1], 'walk') AND NOT ends_with(string_split(fqn, '::')[-1], 'token') AND {_LANG} = 'rust' AND string_split(fqn, '::')[1] <> ''")(
    lambda g: _ids(ask.selected(g, "*::**::walk*!token"), "fqn")
)
query("selector_alternatives", f"SELECT graph_id, nid, fqn FROM n WHERE string_split(fqn, '::')[-2] = 'store' AND string_split(fqn, '::')[-1] IN ('seal_scope', 'seal_lease', 'load_scope', 'load_lease') AND {_LANG} IN ('python', 'java', 'typescript')")(
    lambda g: _ids(ask.selected(g, "**.store.(seal|load)_(scope|lease)"), "fqn")
)
query("selector_agnostic", f"SELECT graph_id, nid, fqn, {_LANG} <> 'rust' AS cross_language FROM n WHERE len(string_split(fqn, '::')) = 3 AND starts_with(fqn, 'aux::')")(lambda g: _ids(ask.selected(g, "aux::*::*", True), "fqn", "cross_language"))
query("resolve_batch", f"""SELECT nid, fqn, 'aux::**' AS selector FROM n WHERE starts_with(fqn, 'aux::') AND {_LANG} = 'rust' OR fqn = 'aux' AND {_LANG} = 'rust'
UNION ALL SELECT nid, fqn, '**.join' FROM n WHERE string_split(fqn, '::')[-1] = 'join' AND {_LANG} IN ('python', 'java', 'typescript')""")(lambda g: ask.resolve_all(g, ["aux::**", "**.join"]).select("nid", "fqn", "selector"))
query("nodes_of_kind", "SELECT graph_id, nid, fqn FROM n WHERE kind IN ('lambda', 'macro')")(lambda g: _ids(ask.nodes_of_kind(g, "lambda", "macro"), "fqn"))
query("interface_map", """SELECT DISTINCT e.graph_id, s.fqn AS type, t.fqn AS interface FROM e JOIN n s ON s.nid = e.src JOIN n t ON t.nid = e.dst WHERE e.kind = 'implements'""")(lambda g: ask.interface_map(g, limit=None))
query("dependency_footprint", _bfs_sql(f"fqn = '{BOOT}'", 2, True, columns="w.root, count(*) AS total, count(*) FILTER (w.depth = 1) AS direct, count(*) FILTER (n.file = '<external>') AS external") + " GROUP BY w.root", True)(lambda g: ask.dependency_footprint(g, BOOT))
query("dump_symbol", "SELECT DISTINCT e.eid, e.src, e.dst, e.kind FROM e JOIN n ON n.nid IN (e.src, e.dst) WHERE contains(n.fqn, 'rand')")(lambda g: ask.dump(g, "rand").select("eid", "src", "dst", "kind"))
query("export_edges", "SELECT eid, src, dst, kind FROM c WHERE kind = 'calls-virtual' AND coalesce(confidence, 'possible') <> 'possible' AND eid >= 8589934592 ORDER BY eid LIMIT 1000")(lambda g: ask.export_edges(g, 2 << 32, 1000, "calls-virtual", "probable").select("eid", "src", "dst", "kind"))
query("page_of_nodes", "SELECT nid, fqn FROM n ORDER BY nid LIMIT 20 OFFSET 40")(lambda g: ask.page(g.node_rows("fqn"), ["nid"], 40))
query(
    "doctor",
    f"""--cte ee AS (SELECT graph_id, count(*) AS n_edges, count(*) FILTER (kind IN {_CALLS}) AS n_calls, count(*) FILTER (kind IN {_CALLS} AND confidence = 'certain') AS n_certain, count(*) FILTER (kind IN {_CALLS} AND confidence = 'probable') AS n_probable,
 count(*) FILTER (kind IN {_CALLS} AND confidence = 'possible') AS n_possible, count(*) FILTER (list_contains(cut_markers, 'unresolved')) AS cut_unresolved, count(*) FILTER (list_contains(cut_markers, 'external')) AS cut_external FROM e GROUP BY 1),
nn AS (SELECT graph_id, count(*) AS n_nodes, CAST(sum(unresolved_calls + external_calls + narrowing.visible_dropped_out) AS BIGINT) AS n_dangling FROM n GROUP BY 1),
r AS (SELECT *, cut_unresolved / n_calls AS ur, n_possible / n_calls AS ps, n_certain = 0 AND n_probable = 0 AS guessed FROM nn JOIN ee USING (graph_id)),
q AS (SELECT *, CAST(guessed AS INT) + CAST(coalesce(ur, 0) > 0.5 AS INT) + CAST(coalesce(ps, 0) > 0.85 AS INT) AS odd FROM r)
SELECT graph_id, n_nodes, n_edges, n_calls, n_certain, n_probable, n_possible, cut_unresolved, cut_external, n_dangling,
 CASE WHEN odd >= 2 THEN 'low' WHEN odd > 0 OR coalesce(ur, 0) > 0.3 OR coalesce(ps, 0) > 0.6 THEN 'moderate' ELSE 'high' END AS trust FROM q""",
)(lambda g: ask.doctor(g).select("graph_id", "n_nodes", "n_edges", "n_calls", "n_certain", "n_probable", "n_possible", "cut_unresolved", "cut_external", "n_dangling", "trust"))
query("max_candidates", f"""--cte sz AS (SELECT graph_id, candidate_group, count(*) AS size FROM (SELECT DISTINCT * FROM candidates) GROUP BY ALL)
SELECT c.eid FROM c LEFT JOIN sz ON sz.graph_id = c.graph_id AND sz.candidate_group = c.candidate_group WHERE coalesce(sz.size, 1) <= 2""")(lambda g: EdgeFilter(max_candidates=2).apply(g, "eid"))
query("effects_own", "SELECT graph_id, CAST(bit_or(own_effects) AS INT) AS effects, count(*) AS n FROM n GROUP BY graph_id")(lambda g: g.node_rows("graph_id", "own_effects").groupBy("graph_id").agg(F.bit_or("own_effects").alias("effects"), F.count(F.lit(1)).alias("n")))
query("call_sites", "SELECT DISTINCT graph_id, site_id, src AS caller, stmt_index FROM e WHERE site_id IS NOT NULL")(lambda g: g.raw_edges.where(F.col("site_id").isNotNull()).select("graph_id", "site_id", F.col("src").alias("caller"), "stmt_index").distinct())
_IMPACT_SQL = """--cte ch AS (SELECT nid FROM n WHERE fqn LIKE '%::net::%' AND kind = 'function'),
own AS (SELECT graph_id, fqn, min(nid) AS nid FROM n GROUP BY ALL),
st AS (SELECT dst AS a, src AS b FROM c UNION SELECT l.nid, o.nid FROM n l JOIN own o ON o.graph_id = l.graph_id AND o.fqn = regexp_extract(l.fqn, '^(.*)::\\{(?:closure|func)@[^{}]*\\}$', 1)),
w AS (SELECT nid FROM ch UNION SELECT st.b FROM w JOIN st ON st.a = w.nid)
SELECT n.graph_id, n.nid AS test, n.fqn FROM w JOIN n ON n.nid = w.nid WHERE n.entrypoint_kind = 'test'"""
query("impacted_tests", _IMPACT_SQL, True)(lambda g: ask.impacted_tests(g, g.raw_nodes.where(F.col("fqn").like("%::net::%") & (F.col("kind") == "function")).select("nid")).select("graph_id", "test", "fqn"))


# pairs of consecutive snapshots of each repository: series is the repository's least graph_id, seq that of the base
_BY = ("series", "seq")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(graph_id, repo, series, seq) of the snapshots that are a base, and of those that are a head; seq is the base's in both."""
    from .operators.snapshots import snapshot_order

    order = snapshot_order(table(spark, d, "graphs"))
    of = order.groupBy("repo").agg(F.min("graph_id").alias("series"), F.max("seq").alias("last"))
    x = order.join(of, "repo").select("graph_id", "repo", "series", "seq", "last")
    return x.where(F.col("seq") < F.col("last")).drop("last"), x.where(F.col("seq") > 0).withColumn("seq", F.col("seq") - 1).drop("last")


def _pairs(spark: SparkSession, d: str) -> tuple[CodeGraph, CodeGraph]:
    g = CodeGraph.load(spark, d)
    of = lambda x, side: x.join(side.select("graph_id", *_BY), "graph_id")
    return tuple(CodeGraph(of(g.raw_nodes, s), of(g.raw_edges, s), g.candidates, g.unique) for s in _sides(spark, d))


_EACH_O = """o AS (SELECT graph_id, repo, min(graph_id) OVER (PARTITION BY repo) AS series, row_number() OVER (PARTITION BY repo ORDER BY committed_at, graph_id) - 1 AS seq, count(*) OVER (PARTITION BY repo) AS snapshots FROM (SELECT DISTINCT graph_id, repo, committed_at FROM graphs)),
side AS (SELECT graph_id, repo, series, seq, 0 AS side FROM o WHERE seq < snapshots - 1 UNION ALL SELECT graph_id, repo, series, seq - 1, 1 FROM o WHERE seq > 0)"""
# per pair of snapshots and name of an edge what either side has; sides are told apart by what they hold, not by joins
_EACH = f"""{_EACH_O},
sz AS (SELECT graph_id, candidate_group, count(*) AS size FROM (SELECT DISTINCT * FROM candidates) GROUP BY ALL),
facts AS (SELECT o.series, o.seq, o.side, s.fqn AS src_fqn, t.fqn AS dst_fqn, e.kind, s.file, ifnull(e.stmt_index, -1) AS anchor, arg_max({{'c': e.condition, 'f': e.confidence, 't': e.tier, 'g': ifnull(sz.size, 0), 'k': e.cfg_condition}}, e.eid) AS v
 FROM side o JOIN e ON e.graph_id = o.graph_id JOIN n s ON s.nid = e.src JOIN n t ON t.nid = e.dst LEFT JOIN sz ON sz.graph_id = e.graph_id AND sz.candidate_group = e.candidate_group GROUP BY ALL),
told AS (SELECT series, seq, src_fqn, dst_fqn, kind, file, anchor, count(*) AS sides, min(side) AS first_side, list(v) AS vs, count(DISTINCT v) AS versions FROM facts GROUP BY ALL)"""
_HOW = "CASE WHEN sides = 2 THEN 'changed' WHEN first_side = 1 THEN 'added' ELSE 'removed' END"
SQL["diff_graphs"] = f"""WITH {_BASE}, {_EACH},
nd AS (SELECT DISTINCT o.series, o.seq, o.side, fqn FROM n JOIN side o USING (graph_id))
SELECT series, seq, 'edge' AS record_type, src_fqn AS fqn, dst_fqn, kind, anchor, {_HOW} AS change FROM told WHERE sides = 1 OR versions > 1
UNION ALL SELECT series, seq, 'node', fqn, '', '', -1, CASE WHEN min(side) = 1 THEN 'added' ELSE 'removed' END FROM nd GROUP BY series, seq, fqn HAVING count(*) = 1"""
QUERIES["diff_graphs"] = lambda spark, d: diff.diff_graphs(*_pairs(spark, d), _BY).select(*_BY, "record_type", "fqn", "dst_fqn", "kind", "anchor", "change")
SQL["diff_filtered"] = f"""WITH {_BASE}, {_EACH} SELECT series, seq, src_fqn AS fqn, dst_fqn, anchor FROM told
WHERE sides = 2 AND versions > 1 AND kind = 'calls' AND list_contains(list_transform(vs, lambda x: x.c), 'exception')"""
QUERIES["diff_filtered"] = lambda spark, d: diff.DiffFilter(("changed",), ("calls",), "exception").apply(diff.diff_graphs(*_pairs(spark, d), _BY)).select(*_BY, "fqn", "dst_fqn", "anchor")
SQL["edges_newer"] = f"WITH {_BASE}, {_EACH} SELECT series, seq, src_fqn, dst_fqn, kind, file, anchor FROM told WHERE sides = 1 AND first_side = 1"
QUERIES["edges_newer"] = lambda spark, d: diff.newer_edges(*_pairs(spark, d), _BY).select(*_BY, "src_fqn", "dst_fqn", "kind", "file", "anchor")
SQL["dirty_files"] = f"""WITH {_EACH_O},
m AS (SELECT DISTINCT o.series, o.seq, o.side, o.repo || '/' || path AS path, blob_oid FROM manifest JOIN side o USING (graph_id)), a AS (SELECT * FROM m WHERE side = 0), b AS (SELECT * FROM m WHERE side = 1)
SELECT coalesce(a.series, b.series) AS series, coalesce(a.seq, b.seq) AS seq, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS state FROM a FULL JOIN b ON a.path = b.path AND a.series = b.series AND a.seq = b.seq WHERE a.blob_oid IS DISTINCT FROM b.blob_oid"""


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest")
    a, b = (m.join(s, "graph_id").select(*_BY, F.concat_ws("/", "repo", "path").alias("path"), "blob_oid") for s in _sides(spark, d))
    return diff.dirty_files(a, b, _BY)


QUERIES["dirty_files"] = _dirty
_COMMITS = """o AS (SELECT graph_id, repo, row_number() OVER (PARTITION BY repo ORDER BY committed_at, graph_id) AS nth FROM (SELECT DISTINCT graph_id, repo, committed_at FROM graphs)),
m AS (SELECT DISTINCT graph_id, repo || '/' || path AS path, blob_oid FROM manifest JOIN o USING (graph_id)),
f0 AS (SELECT h.graph_id, m.path FROM o h JOIN o b ON b.repo = h.repo AND b.nth = h.nth - 1 JOIN m ON m.graph_id = h.graph_id ANTI JOIN m old ON old.graph_id = b.graph_id AND old.path = m.path AND old.blob_oid = m.blob_oid),
f AS (SELECT DISTINCT graph_id, path FROM f0 WHERE graph_id IN (SELECT graph_id FROM f0 GROUP BY 1 HAVING count(DISTINCT path) <= 50)), per AS (SELECT path, count(*) AS n FROM f GROUP BY 1)"""
SQL["coupling"] = f"""WITH {_COMMITS} SELECT a.path AS file_a, b.path AS file_b, count(*) AS cochanges, any_value(pa.n) AS changes_a, any_value(pb.n) AS changes_b FROM f a JOIN f b ON a.graph_id = b.graph_id AND a.path < b.path
JOIN per pa ON pa.path = a.path JOIN per pb ON pb.path = b.path GROUP BY 1, 2 HAVING count(*) >= 2"""


def _coupling(spark: SparkSession, d: str) -> DataFrame:
    """Files that change in the same snapshots: a snapshot is a commit that touches the files whose blob is new against the one before; first
    snapshots are roots. As in the history of a repository, commits of over 50 files are bulk changes and tell nothing."""
    base, head = _sides(spark, d)
    m = table(spark, d, "manifest").select("graph_id", "path", "blob_oid").distinct()
    of = lambda side: m.join(side, "graph_id").select(*_BY, "graph_id", F.concat_ws("/", "repo", "path").alias("path"), "blob_oid")
    touched = of(head).join(of(base).drop("graph_id"), [*_BY, "path", "blob_oid"], "left_anti")
    return diff.coupling(touched.select(F.col("graph_id").alias("commit"), F.lit(1).alias("n_parents"), "path"), limit=None)


QUERIES["coupling"] = _coupling


# passes over the linked graph
from .link import passes  # noqa: E402

_SIX = "('calls','calls-virtual','calls-closure','calls-callback','calls-async','calls-indirect')"
query(
    "effect_closure",
    f"""--cte k AS (SELECT DISTINCT src, dst FROM e WHERE kind IN {_SIX}), w AS (SELECT nid, CAST(1 << b AS INT) AS bit FROM n, range(16) t(b) WHERE (own_effects & (1 << b)::INT) > 0 UNION SELECT k.src, w.bit FROM w JOIN k ON k.dst = w.nid)
SELECT n.nid, coalesce(x.bits, 0) AS transitive_effects FROM n LEFT JOIN (SELECT nid, CAST(bit_or(bit) AS INT) AS bits FROM w GROUP BY 1) x ON x.nid = n.nid""",
    True,
)(passes.effect_closure)
_UP = "u AS (SELECT DISTINCT src AS sub, src AS super FROM e WHERE kind IN ('implements', 'inherits') UNION SELECT DISTINCT dst, dst FROM e WHERE kind IN ('implements', 'inherits') UNION SELECT u.sub, e.dst FROM u JOIN e ON e.src = u.super AND e.kind IN ('implements', 'inherits'))"
query("supertypes", f"--cte {_UP} SELECT sub, super FROM u", True)(passes.supertypes)
query(
    "cha_targets",
    f"""--cte {_UP}, ty AS (SELECT graph_id, fqn AS type, min(nid) AS t FROM n WHERE kind = 'type' GROUP BY ALL),
has AS (SELECT m.graph_id, ty.t, string_split(m.fqn, '::')[-1] AS method, m.nid AS body, m.is_abstract FROM n m JOIN ty ON ty.graph_id = m.graph_id AND ty.type = regexp_extract(m.fqn, '^(.*)::[^:]*$', 1) WHERE m.kind IN ('method', 'function')),
b AS (SELECT d.graph_id, d.method, CASE WHEN h.body IS NOT NULL AND NOT h.is_abstract THEN h.body WHEN h.body IS NULL AND NOT d.is_abstract THEN d.body END AS dst FROM has d JOIN u ON u.super = d.t LEFT JOIN has h ON h.t = u.sub AND h.method = d.method)
SELECT DISTINCT graph_id, method, dst FROM b WHERE dst IS NOT NULL""",
    True,
)(passes.cha_targets)
QUERIES["link_cha"] = lambda spark, d: passes.cha(CodeGraph.load(spark, d)).edges.where(F.col("kind") == "calls-virtual").select("graph_id", "src", "dst", "rule", "confidence", "site_id")
QUERIES["link_rta"] = lambda spark, d: passes.rta(passes.cha(CodeGraph.load(spark, d))).edges.where(F.col("kind") == "calls-virtual").select("graph_id", "src", "dst", "rule", "confidence", "site_id")

# the same in SQL, from the facts of sites and types
_CHA = f"""{_UP}, ty AS (SELECT graph_id, fqn AS type, min(nid) AS t FROM n WHERE kind = 'type' GROUP BY ALL),
has AS (SELECT m.graph_id, ty.t, string_split(m.fqn, '::')[-1] AS method, m.nid AS body, m.is_abstract FROM n m JOIN ty ON ty.graph_id = m.graph_id AND ty.type = regexp_extract(m.fqn, '^(.*)::[^:]*$', 1) WHERE m.kind IN ('method', 'function')),
can AS (SELECT DISTINCT graph_id, method, dst FROM (SELECT d.graph_id, d.method, CASE WHEN h.body IS NOT NULL AND NOT h.is_abstract THEN h.body WHEN h.body IS NULL AND NOT d.is_abstract THEN d.body END AS dst
 FROM has d JOIN u ON u.super = d.t LEFT JOIN has h ON h.t = u.sub AND h.method = d.method) WHERE dst IS NOT NULL),
site AS (SELECT graph_id, src, site_id, min(eid) AS eid FROM e WHERE kind = 'calls-virtual' AND rule = 'name-method' AND site_id IS NOT NULL GROUP BY ALL),
hit AS (SELECT site.*, can.dst AS target FROM site JOIN e USING (eid) JOIN n ON n.nid = e.dst JOIN can ON can.graph_id = site.graph_id AND can.method = string_split(n.fqn, '::')[-1]),
sized AS (SELECT *, count(*) OVER (PARTITION BY graph_id, src, site_id) AS size FROM hit),
ce AS (SELECT e.graph_id, e.src, e.dst, e.kind, e.rule, e.confidence, e.site_id, len(e.cut_markers) AS cuts FROM e WHERE NOT (e.rule = 'name-method' AND e.site_id IS NOT NULL AND (e.graph_id, e.src, e.site_id) IN (SELECT (graph_id, src, site_id) FROM hit))
 UNION ALL SELECT s.graph_id, s.src, s.target, e.kind, 'cha-trait-set', CASE WHEN s.size = 1 THEN 'probable' ELSE 'possible' END, s.site_id, len(e.cut_markers) + CASE WHEN s.size > 64 AND NOT list_contains(e.cut_markers, 'unresolved') THEN 1 ELSE 0 END FROM sized s JOIN e USING (eid))"""
SQL["link_cha"] = f"WITH RECURSIVE {_BASE}, {_CHA} SELECT graph_id, src, dst, rule, confidence, site_id FROM ce WHERE kind = 'calls-virtual'"
SQL["link_rta"] = f"""WITH RECURSIVE {_BASE}, {_CHA},
live AS (SELECT nid FROM n WHERE entrypoint_kind IS NOT NULL OR kind IN ('function', 'method', 'lambda') AND graph_id NOT IN (SELECT graph_id FROM n WHERE entrypoint_kind IS NOT NULL) UNION SELECT ce.dst FROM live JOIN ce ON ce.src = live.nid AND ce.kind IN {_CALLS}),
made AS (SELECT ce.*, n.fqn AS type FROM ce JOIN n ON n.nid = ce.dst WHERE ce.kind = 'instantiates' AND ce.src IN (SELECT nid FROM live)),
judged AS (SELECT ce.*, regexp_extract(n.fqn, '^(.*)::[^:]*$', 1) AS type FROM ce JOIN n ON n.nid = ce.dst WHERE ce.rule = 'cha-trait-set' AND ce.site_id IS NOT NULL),
kept AS (SELECT *, type = '' OR (graph_id, type) IN (SELECT (graph_id, type) FROM made) AS keep FROM judged),
bysite AS (SELECT *, count(*) FILTER (keep) OVER w AS n_keep, count(*) OVER w AS n_all, max(cuts) OVER w AS site_cuts FROM kept WINDOW w AS (PARTITION BY graph_id, src, site_id)),
cutting AS (SELECT *, site_cuts = 0 AND n_keep BETWEEN 1 AND n_all - 1 AND graph_id NOT IN (SELECT graph_id FROM made WHERE cuts > 0) AS pruned FROM bysite)
SELECT graph_id, src, dst, rule, confidence, site_id FROM ce WHERE kind = 'calls-virtual' AND (rule <> 'cha-trait-set' OR site_id IS NULL)
UNION ALL SELECT graph_id, src, dst, CASE WHEN pruned THEN 'rta-pruned' ELSE rule END, CASE WHEN pruned THEN 'probable' ELSE confidence END, site_id FROM cutting WHERE kind = 'calls-virtual' AND (keep OR NOT pruned)"""

# circles of containment and of inheritance as components
from .operators import components  # noqa: E402

query(
    "components_structure",
    """--cte s AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ('contains', 'inherits', 'implements') AND src <> dst), far AS (SELECT src AS a, dst AS b FROM s UNION SELECT far.a, s.dst FROM far JOIN s ON s.src = far.b),
ends AS (SELECT src AS node FROM s UNION SELECT dst FROM s), part AS (SELECT ends.node, least(ends.node, min(x.b)) AS component FROM ends LEFT JOIN (SELECT f.a, f.b FROM far f JOIN far r ON r.a = f.b AND r.b = f.a) x ON x.a = ends.node GROUP BY 1)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM part""",
    True,
)(lambda g: components.components(g.raw_edges.where(F.col("kind").isin("contains", "inherits", "implements"))))


# what an answer may lack
from .operators import contract  # noqa: E402

SQL["contract_callees"] = f"""WITH RECURSIVE {_BASE}, s AS (SELECT graph_id, min(nid) AS nid FROM n WHERE fqn = '{BOOT}' GROUP BY graph_id), a AS (SELECT * FROM c WHERE confidence IN ('probable', 'certain')),
w0 AS (SELECT nid AS root, nid, 0 AS depth FROM s UNION SELECT w0.root, a.dst, w0.depth + 1 FROM w0 JOIN a ON a.src = w0.nid WHERE w0.depth < 2), t AS (SELECT nid, min(depth) AS depth FROM w0 GROUP BY 1),
nn AS (SELECT CAST(sum(n.unresolved_calls) AS BIGINT) AS unresolved_calls, CAST(sum(CASE WHEN t.depth < 2 THEN n.external_calls ELSE 0 END) AS BIGINT) AS external_calls FROM t JOIN n ON n.nid = t.nid),
ee AS (SELECT count(*) FILTER (list_contains(cut_markers, 'external')) AS cut_external, count(*) FILTER (list_contains(cut_markers, 'dynamic')) AS cut_dynamic, count(*) FILTER (coalesce(confidence, 'possible') = 'possible') AS below_floor FROM t JOIN c ON c.src = t.nid),
hh AS (SELECT count(*) AS horizon FROM t JOIN a ON a.src = t.nid WHERE t.depth = 2 AND a.dst NOT IN (SELECT nid FROM t)) SELECT * FROM nn, ee, hh"""
QUERIES["contract_callees"] = lambda spark, d: (lambda g: contract.frontier(g, ask.resolve_one(g, BOOT), True, 2, EdgeFilter(confidence="probable")).select("unresolved_calls", "external_calls", "cut_external", "cut_dynamic", "below_floor", "horizon"))(CodeGraph.load(spark, d))
