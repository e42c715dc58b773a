"""Queries in the query language over all graphs of the store, with the same in SQL."""

from __future__ import annotations

from .graph import CodeGraph
from .graph_queries import _BASE, BOOT, HUB, SINK
from .plans.cql import plain, run

QUERIES: dict = {}
SQL: dict[str, str] = {}
_SIX = "('calls','calls-virtual','calls-closure','calls-callback','calls-async','calls-indirect')"


def query(name: str, text: str, sql: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, d: plain(run(CodeGraph.load(spark, d), text))
    SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{_BASE}, k AS (SELECT * FROM e WHERE kind IN {_SIX}){', ' if sql.startswith('--cte') else ' '}" + sql.replace("--cte", "", 1)


query("cql_top_callers", 'MATCH (a:function)-[r:CALLS {confidence: "probable"}]->(b) RETURN a.name AS caller, count(*) AS n ORDER BY n DESC LIMIT 20',
      "SELECT a.fqn AS caller, count(*) AS n FROM k JOIN n a ON a.nid = k.src JOIN n b ON b.nid = k.dst WHERE a.kind = 'function' AND k.confidence IN ('probable', 'certain') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
query("cql_single_hop", f'MATCH (a)-[r:CALLS]->(b {{name: "{SINK}"}}) WHERE r.condition <> "always" AND a.line > 5 RETURN a.fqn AS caller, a.file AS file, a.line AS line, r.condition AS condition, r.kind AS kind',
      f"SELECT a.fqn AS caller, a.file, a.line_start AS line, k.condition, k.kind FROM k JOIN n a ON a.nid = k.src JOIN n b ON b.nid = k.dst WHERE b.fqn = '{SINK}' AND k.condition <> 'always' AND a.line_start > 5")
query("cql_reverse_arrow", "MATCH (t:type)<-[:INHERITS|IMPLEMENTS]-(s:type) RETURN DISTINCT t.name AS base, s.name AS derived",
      "SELECT DISTINCT t.fqn AS base, s.fqn AS derived FROM e JOIN n s ON s.nid = e.src JOIN n t ON t.nid = e.dst WHERE e.kind IN ('inherits', 'implements') AND s.kind = 'type' AND t.kind = 'type'")
query("cql_member_of", "MATCH (m:method)-[:MEMBER_OF]->(t:type) RETURN t.fqn AS type, count(m) AS methods",
      "SELECT t.fqn AS type, count(*) AS methods FROM e JOIN n t ON t.nid = e.src JOIN n m ON m.nid = e.dst WHERE e.kind = 'contains' AND m.kind = 'method' AND t.kind = 'type' GROUP BY 1")
query("cql_chain", "MATCH (t:type)-[:CONTAINS]->(m:method)-[:CALLS]->(c:function) RETURN t.name AS type, m.name AS method, c.name AS callee",
      "SELECT t.fqn AS type, m.fqn AS method, c2.fqn AS callee FROM e x JOIN n t ON t.nid = x.src JOIN n m ON m.nid = x.dst JOIN k ON k.src = m.nid JOIN n c2 ON c2.nid = k.dst WHERE x.kind = 'contains' AND t.kind = 'type' AND m.kind = 'method' AND c2.kind = 'function'")
query("cql_two_patterns", f'MATCH (a)-[:CALLS]->(b {{name: "{HUB}"}}), (a)-[:CALLS]->(c {{name: "{SINK}"}}) RETURN DISTINCT a.fqn AS caller',
      f"SELECT DISTINCT a.fqn AS caller FROM n a SEMI JOIN (SELECT k.src FROM k JOIN n b ON b.nid = k.dst WHERE b.fqn = '{HUB}') x ON x.src = a.nid SEMI JOIN (SELECT k.src FROM k JOIN n b ON b.nid = k.dst WHERE b.fqn = '{SINK}') y ON y.src = a.nid")
query("cql_var_length", f'MATCH (a {{fqn: "{BOOT}"}})-[:CALLS*1..3]->(b:method) RETURN DISTINCT b.fqn AS reached',
      f"--cte w AS (SELECT nid AS root, nid, 0 AS d FROM n WHERE fqn = '{BOOT}' UNION SELECT w.root, k.dst, w.d + 1 FROM w JOIN k ON k.src = w.nid WHERE w.d < 3) SELECT DISTINCT n.fqn AS reached FROM w JOIN n ON n.nid = w.nid WHERE w.d > 0 AND n.kind = 'method'", True)
query("cql_recursion", "MATCH (a)-[:CALLS*1..3]->(a) RETURN a.fqn AS name, a.file AS file",
      "--cte w AS (SELECT src AS root, dst AS nid, 1 AS d FROM k UNION SELECT w.root, k.dst, w.d + 1 FROM w JOIN k ON k.src = w.nid WHERE w.d < 3) SELECT n.fqn AS name, n.file FROM (SELECT DISTINCT root FROM w WHERE root = nid) r JOIN n ON n.nid = r.root", True)
query("cql_data_flow", "MATCH (a)-[:DATA_FLOW*1..8]->(b) RETURN a.fqn AS value, count(*) AS sources",
      "--cte w AS (SELECT src AS root, dst AS nid, 1 AS d FROM e WHERE kind = 'derives-from' UNION SELECT w.root, e.dst, w.d + 1 FROM w JOIN e ON e.src = w.nid AND e.kind = 'derives-from' WHERE w.d < 8), p AS (SELECT DISTINCT root, nid FROM w) SELECT n.fqn AS value, count(*) AS sources FROM p JOIN n ON n.nid = p.root GROUP BY 1", True)
_TRAIL = f"""--cte w AS (SELECT nid AS root, nid AS here, [nid] AS ns, []::BIGINT[] AS es, []::VARCHAR[] AS cs FROM n WHERE fqn = '{BOOT}'
 UNION ALL SELECT w.root, k.dst, list_append(ns, k.dst), list_append(es, k.eid), list_append(cs, k.condition) FROM w JOIN c k ON k.src = w.here WHERE len(es) < 3 AND NOT list_contains(es, k.eid)),
t AS (SELECT w.* FROM w JOIN n g ON g.nid = w.here WHERE g.fqn = '{SINK}' AND len(es) > 0 AND NOT list_contains(ns[2:-2], w.here))"""
query("cql_path_transience", f'MATCH p = (a {{fqn: "{BOOT}"}})-[*1..3]->(b {{fqn: "{SINK}"}}) WHERE ANY(r IN relationships(p) WHERE r.condition IN ["exception", "panic"]) RETURN a.file AS file, length(p) AS hops, [r IN relationships(p) | r.condition] AS conditions',
      _TRAIL + " SELECT a.file, CAST(len(es) AS INTEGER) AS hops, array_to_string(cs, ',') AS conditions FROM t JOIN n a ON a.nid = t.root WHERE list_has_any(cs, ['exception', 'panic'])", True)
query("cql_path_avoiding", f'MATCH p = (a {{fqn: "{BOOT}"}})-[*2..3]->(b {{fqn: "{SINK}"}}) WHERE NONE(x IN nodes(p) WHERE x.kind = "method") RETURN size(nodes(p)) AS nodes, count(*) AS paths, max(length(p)) AS longest',
      _TRAIL + " SELECT CAST(len(ns) AS INTEGER) AS nodes, count(*) AS paths, CAST(max(len(es)) AS INTEGER) AS longest FROM t WHERE len(es) >= 2 AND NOT EXISTS (SELECT 1 FROM n m WHERE list_contains(t.ns, m.nid) AND m.kind = 'method') GROUP BY 1", True)
query("cql_exists", 'MATCH (t:type)-[:CONTAINS]->(m:method) WHERE (m)<-[:CALLS]-() AND NOT (m)-[:CALLS]->() RETURN m.fqn AS method',
      "SELECT m.fqn AS method FROM e JOIN n t ON t.nid = e.src JOIN n m ON m.nid = e.dst WHERE e.kind = 'contains' AND t.kind = 'type' AND m.kind = 'method' AND m.nid IN (SELECT dst FROM k) AND m.nid NOT IN (SELECT src FROM k)")
query("cql_exists_or", 'MATCH (t:type)-[:CONTAINS]->(m:method) WHERE (m)<-[:SPAWNS]-() OR m.line < 10 RETURN m.fqn AS method',
      "SELECT m.fqn AS method FROM e JOIN n t ON t.nid = e.src JOIN n m ON m.nid = e.dst WHERE e.kind = 'contains' AND t.kind = 'type' AND m.kind = 'method' AND (m.nid IN (SELECT dst FROM e WHERE kind = 'spawns') OR m.line_start < 10)")
query("cql_with_filter", "MATCH (a:function)-[:CALLS]->(b) WITH a, count(*) AS n, collect(b.kind) AS kinds WHERE n > 3 AND \"method\" IN kinds RETURN a.fqn AS caller, n AS n ORDER BY n DESC",
      "SELECT a.fqn AS caller, count(*) AS n FROM k JOIN n a ON a.nid = k.src JOIN n b ON b.nid = k.dst WHERE a.kind = 'function' GROUP BY a.nid, a.fqn HAVING count(*) > 3 AND bool_or(b.kind = 'method')")
query("cql_with_limit_first", "MATCH (a)-[:CALLS]->(b) WITH b, count(*) AS n ORDER BY n DESC LIMIT 10 WHERE n > 5 RETURN b.fqn AS callee, n AS n",
      "SELECT b.fqn AS callee, x.n FROM (SELECT k.dst, count(*) AS n FROM k JOIN n a ON a.nid = k.src JOIN n b ON b.nid = k.dst GROUP BY 1 ORDER BY n DESC, dst LIMIT 10) x JOIN n b ON b.nid = x.dst WHERE x.n > 5")
query("cql_collect", 'MATCH (t:type)-[:CONTAINS]->(m:method) WITH t, collect(m) AS ms RETURN t.fqn AS type, t.file AS file, [x IN ms WHERE x.line > 10 | x.name] AS names, size(ms) AS n',
      "SELECT t.fqn AS type, t.file, coalesce(string_agg(m.fqn, ',' ORDER BY least(t.nid, m.nid), m.nid) FILTER (m.line_start > 10), '') AS names, CAST(count(*) AS INTEGER) AS n FROM e JOIN n t ON t.nid = e.src JOIN n m ON m.nid = e.dst WHERE e.kind = 'contains' AND t.kind = 'type' AND m.kind = 'method' GROUP BY t.nid, t.fqn, t.file")
query("cql_min_confidence", "MATCH (a:method)-[r:CALLS]->(b) RETURN a.fqn AS caller, min(r.confidence) AS weakest, max(r.confidence) AS strongest, count(r.confidence) AS n",
      "SELECT a.fqn AS caller, ['possible', 'probable', 'certain'][min(list_position(['possible', 'probable', 'certain'], k.confidence))] AS weakest, ['possible', 'probable', 'certain'][max(list_position(['possible', 'probable', 'certain'], k.confidence))] AS strongest, count(k.confidence) AS n FROM k JOIN n a ON a.nid = k.src JOIN n b ON b.nid = k.dst WHERE a.kind = 'method' GROUP BY 1")
query("cql_null_logic", "MATCH (a:lambda)-[r:CALLS]->(b) WHERE NOT (r.confidence <> \"certain\") RETURN a.fqn AS caller, b.fqn AS callee",
      "SELECT a.fqn AS caller, b.fqn AS callee FROM k JOIN n a ON a.nid = k.src JOIN n b ON b.nid = k.dst WHERE a.kind = 'lambda' AND (k.confidence = 'certain' OR k.confidence IS NULL)")
query("cql_global_count", 'MATCH (a:macro)-[:SPAWNS]->(b:macro) RETURN count(*) AS n', "SELECT count(*) AS n FROM e JOIN n a ON a.nid = e.src JOIN n b ON b.nid = e.dst WHERE e.kind = 'spawns' AND a.kind = 'macro' AND b.kind = 'macro'")
query("cql_select", 'MATCH (a)-[:CALLS]->(b) WHERE select(b, "aux::*::jo*") AND NOT select(a, "boot::**", agnostic) RETURN a.fqn AS caller, b.fqn AS callee',
      "SELECT a.fqn AS caller, b.fqn AS callee FROM k JOIN n a ON a.nid = k.src JOIN n b ON b.nid = k.dst WHERE lower(trim(b.lang)) IN ('rust', 'rs') AND len(string_split(b.fqn, '::')) = 3 AND starts_with(b.fqn, 'aux::') AND starts_with(string_split(b.fqn, '::')[3], 'jo') AND string_split(a.fqn, '::')[1] <> 'boot'")
query("cql_anti_join", 'MATCH (t:type)-[:CONTAINS]->(m:method) WHERE NOT (m)<-[:CALLS*1..2]-(:function) RETURN m.fqn AS dead',
      "--cte w AS (SELECT nid AS root, nid, 0 AS d FROM n WHERE kind = 'method' UNION SELECT w.root, k.src, w.d + 1 FROM w JOIN k ON k.dst = w.nid WHERE w.d < 2) SELECT m.fqn AS dead FROM e JOIN n t ON t.nid = e.src JOIN n m ON m.nid = e.dst WHERE e.kind = 'contains' AND t.kind = 'type' AND m.kind = 'method' AND m.nid NOT IN (SELECT w.root FROM w JOIN n ON n.nid = w.nid WHERE w.d > 0 AND n.kind = 'function')", True)
query("cql_fanout", "MATCH (f:function)-[:DATA_FLOW]->(x) CALL flow.mutation_fanout(f.fqn) YIELD mutator, confidence AS sure WHERE sure = \"certain\" RETURN DISTINCT f.fqn AS f, mutator.fqn AS mutator",
      """--cte s AS (SELECT f.fqn AS arg, n.graph_id, min(n.nid) AS nid FROM (SELECT DISTINCT a.fqn FROM e JOIN n a ON a.nid = e.src JOIN n b ON b.nid = e.dst WHERE e.kind = 'derives-from' AND a.kind = 'function') f JOIN n ON n.fqn = f.fqn GROUP BY ALL),
w AS (SELECT arg, nid AS root, nid, 0 AS d, NULL::BIGINT AS via, [nid] AS path FROM s UNION ALL SELECT w.arg, w.root, e.dst, w.d + 1, e.eid, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.nid AND e.kind = 'derives-from' WHERE w.d < 8 AND NOT list_contains(w.path, e.dst)),
b AS (SELECT * FROM w WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY arg, root, nid ORDER BY d, path, via) = 1)
SELECT DISTINCT b.arg AS f, n.fqn AS mutator FROM b JOIN n ON n.nid = b.nid JOIN e ON e.eid = b.via WHERE e.confidence = 'certain'""", True)
