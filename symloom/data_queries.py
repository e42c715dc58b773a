"""Queries over the tables of snapshots: hierarchies, changes, heavy symbols; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph_changes, hierarchy, symbol_load
from .session import cut, table


def _contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").where(F.col("kind") == "contains")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    x = hierarchy.cycle_members(_contains(spark, d))
    return x.select(F.col("g").alias("graph_id"), F.col("node").alias("node_id"), F.col("cycle").alias("cycle_id"))


def p2_tree(spark: SparkSession, d: str) -> DataFrame:
    x = hierarchy.hierarchy(_contains(spark, d), table(spark, d, "nodes"))
    return x.select(F.col("g").alias("graph_id"), F.col("node").alias("node_id"), "depth", F.col("root").alias("root_id"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.col("cycle").alias("cycle_id"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    x = hierarchy.descendants(hierarchy.hierarchy(_contains(spark, d)))
    return x.select(F.col("g").alias("graph_id"), F.col("ancestor").alias("ancestor_id"), F.col("node").alias("node_id"), "distance")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return graph_changes.changes(table(spark, d, "graphs"), table(spark, d, "nodes"), table(spark, d, "edges"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return symbol_load.heavy(table(spark, d, "edges"), table(spark, d, "nodes"))


def p4_degrees(spark: SparkSession, d: str) -> DataFrame:
    return symbol_load.degrees(table(spark, d, "edges"), table(spark, d, "nodes"))


QUERIES = {f.__name__: f for f in (p2_found, p2_tree, p2_descendants, p3_found, p4_found, p4_degrees)}

_LINKS = "ct AS (SELECT DISTINCT graph_id, src, dst FROM edges WHERE kind = 'contains')"
_TREE = f"""{_LINKS}, every AS (SELECT graph_id, node_id FROM nodes UNION SELECT graph_id, src FROM ct UNION SELECT graph_id, dst FROM ct),
roots AS (SELECT e.graph_id, e.node_id FROM every e ANTI JOIN ct ON ct.graph_id = e.graph_id AND ct.dst = e.node_id),
tree AS (SELECT graph_id, node_id, 0 AS depth, node_id AS root_id, CAST(node_id AS VARCHAR) AS path FROM roots
 UNION ALL SELECT t.graph_id, c.dst, t.depth + 1, t.root_id, t.path || '/' || CAST(c.dst AS VARCHAR) FROM tree t JOIN ct c ON c.graph_id = t.graph_id AND c.src = t.node_id),
lost AS (SELECT ct.graph_id, ct.dst AS node_id, ct.src AS parent FROM ct ANTI JOIN tree t ON t.graph_id = ct.graph_id AND t.node_id = ct.dst),
walk AS (SELECT graph_id, node_id, parent AS up FROM lost UNION SELECT w.graph_id, w.node_id, l.parent FROM walk w JOIN lost l ON l.graph_id = w.graph_id AND l.node_id = w.up),
rings AS (SELECT graph_id, node_id FROM walk WHERE node_id = up),
found AS (SELECT w.graph_id, w.node_id, min(w.up) AS cycle_id FROM walk w JOIN rings r ON r.graph_id = w.graph_id AND r.node_id = w.up GROUP BY ALL)"""
_SNAP = """g AS (SELECT DISTINCT graph_id, repo, committed_at FROM graphs),
o AS (SELECT graph_id, lag(graph_id) OVER (PARTITION BY repo ORDER BY committed_at, graph_id) AS prev FROM g),
n AS (SELECT DISTINCT graph_id, node_id, fqn, visibility, is_abstract, entrypoint_kind, signature FROM nodes),
e AS (SELECT DISTINCT e.graph_id, s.fqn, t.fqn AS dst_fqn, e.kind AS edge_kind, e.condition, e.confidence, e.tier FROM edges e
 JOIN n s ON s.graph_id = e.graph_id AND s.node_id = e.src JOIN n t ON t.graph_id = e.graph_id AND t.node_id = e.dst)"""
_CHANGES = """SELECT coalesce(a.graph_id, b.graph_id) AS graph_id, '{t}' AS record_type, coalesce(a.fqn, b.fqn) AS fqn, {dst} AS dst_fqn, {kind} AS edge_kind,
 CASE WHEN b.graph_id IS NULL THEN 'added' WHEN a.graph_id IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM (SELECT x.* FROM {r} x JOIN o USING (graph_id) WHERE o.prev IS NOT NULL) a
FULL JOIN (SELECT x.* REPLACE (o.graph_id AS graph_id) FROM {r} x JOIN o ON o.prev = x.graph_id) b ON a.graph_id = b.graph_id AND a.fqn = b.fqn{on}
WHERE a.graph_id IS NULL OR b.graph_id IS NULL OR {differ}"""
_DIFFER = lambda cols: "(" + " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in cols) + ")"
_ONCE = "e AS (SELECT DISTINCT graph_id, edge_id, src, dst FROM edges), n AS (SELECT DISTINCT graph_id, node_id, fqn FROM nodes)"

SQL = {
    "p2_found": f"WITH RECURSIVE {_TREE} SELECT graph_id, node_id, cycle_id FROM found",
    "p2_tree": f"WITH RECURSIVE {_TREE} SELECT graph_id, node_id, depth, root_id, path, NULL::INT AS cycle_id FROM tree UNION ALL SELECT graph_id, node_id, NULL, NULL, NULL, cycle_id FROM found",
    "p2_descendants": f"WITH RECURSIVE {_TREE}, pairs AS (SELECT c.graph_id, c.src AS ancestor_id, c.dst AS node_id, 1 AS distance FROM ct c JOIN tree t ON t.graph_id = c.graph_id AND t.node_id = c.dst UNION ALL SELECT p.graph_id, c.src, p.node_id, p.distance + 1 FROM pairs p JOIN ct c ON c.graph_id = p.graph_id AND c.dst = p.ancestor_id) SELECT * FROM pairs",
    "p3_found": f"WITH {_SNAP} " + _CHANGES.format(t="node", r="n", dst="''", kind="''", on="", differ=_DIFFER(["visibility", "is_abstract", "entrypoint_kind", "signature"]))
    + " UNION ALL " + _CHANGES.format(t="edge", r="e", dst="coalesce(a.dst_fqn, b.dst_fqn)", kind="coalesce(a.edge_kind, b.edge_kind)", on=" AND a.dst_fqn = b.dst_fqn AND a.edge_kind = b.edge_kind", differ=_DIFFER(["condition", "confidence", "tier"])),
    "p4_found": f"""WITH {_ONCE}, c AS (SELECT 'src' AS side, n.fqn, count(*) AS n FROM e JOIN n ON n.graph_id = e.graph_id AND n.node_id = e.src GROUP BY ALL
 UNION ALL SELECT 'dst', n.fqn, count(*) FROM e JOIN n ON n.graph_id = e.graph_id AND n.node_id = e.dst GROUP BY ALL)
SELECT side, fqn FROM c WHERE n >= 0.04 * (SELECT count(*) FROM e)""",
    "p4_degrees": f"""WITH {_ONCE}, x AS (SELECT s.fqn AS src, d.fqn AS dst FROM e LEFT JOIN n s ON s.graph_id = e.graph_id AND s.node_id = e.src LEFT JOIN n d ON d.graph_id = e.graph_id AND d.node_id = e.dst)
SELECT 'src' AS side, src AS fqn, count(*) AS n_edges, count(DISTINCT dst) AS n_peers FROM x WHERE src IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'dst', dst, count(*), count(DISTINCT src) FROM x WHERE dst IS NOT NULL GROUP BY ALL""",
}
