"""Code graphs as DataFrames, many of them in one.

Nodes get one long id, the graph's id above the node's, so that every operator runs over one graph or over all graphs of a
store alike; ids order as (graph, node) does, which is the canonical order of results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.patterns import matches
from .model import CONDITIONS, CONFIDENCES, EDGE_DDL, EDGE_KINDS, NODE_DDL
from .session import table


def packed(graph_id: Column, node_id: Column) -> Column:
    return F.shiftleft(graph_id.cast("long"), 32) + node_id.cast("long")


def _packed(column: str) -> str:
    return f"shiftleft(cast(graph_id as bigint), 32) + cast({column} as bigint)"


def ordinal(c: Column, values: tuple[str, ...]) -> Column:
    """Place of a token in its enumeration, from 0; null for null, -1 for unknown tokens."""
    return (F.array_position(F.array(*[F.lit(v) for v in values]), c) - 1).cast("int")


def token(c: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), c)


# Other spellings of languages.
SPELLINGS = {"golang": "go", "py": "python", "python3": "python", "ts": "typescript", "tsx": "typescript", "c++": "cpp", "cc": "cpp", "rs": "rust"}
_LANG = "case lower(trim(lang)) " + " ".join(f"when '{k}' then '{v}'" for k, v in SPELLINGS.items()) + " else lower(trim(lang)) end"


def plain_lang(c: Column) -> Column:
    """One spelling of the languages' names."""
    low = F.lower(F.trim(c))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv]), low), low)


def _names(ddl: str) -> set[str]:
    """The names of a schema's top-level columns."""
    flat, depth = "", 0
    for c in ddl:
        depth += {"<": 1, ">": -1}.get(c, 0)
        flat += c if not depth else ""
    return {x.split()[0] for x in flat.split(",")}


_NODE_COLUMNS, _EDGE_COLUMNS = _names(NODE_DDL), _names(EDGE_DDL)


@dataclass
class CodeGraph:
    """raw_nodes: nid and the model's node columns. raw_edges: eid, src, dst (as nid) and the model's edge columns. candidates: grp, dst, rank.

    Rows without graph_id or own id, and edges without src or dst, are left out. Unless `unique` says that the tables hold each row once, exact
    duplicates are in the raw tables; node_rows and edge_rows filter and prune first and then take each row once, so that conditions
    and the choice of columns reach the files, and no more is shuffled than is asked for. Walks take raw edges, as their sets absorb duplicates.
    """

    raw_nodes: DataFrame
    raw_edges: DataFrame
    candidates: DataFrame
    unique: bool = True

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, candidates: DataFrame | None = None, unique: bool = False) -> CodeGraph:
        """From tables in the model's schema; graph_id may be missing in all of them (one graph)."""
        if "graph_id" not in nodes.columns:
            nodes, edges = nodes.withColumn("graph_id", F.lit(0)), edges.withColumn("graph_id", F.lit(0))
            candidates = None if candidates is None else candidates.withColumn("graph_id", F.lit(0))
        # columns beyond the model are dropped, so that none clashes with an operator's own
        known = [c for c in nodes.columns if c != "lang" and (c == "graph_id" or c in _NODE_COLUMNS)]
        n = nodes.where("graph_id is not null and node_id is not null").selectExpr(*known, f"{_packed('node_id')} as nid", *([f"{_LANG} as lang"] if "lang" in nodes.columns else []))
        ends = ("src", "dst", "candidate_group")
        known = [c for c in edges.columns if c not in ends and (c == "graph_id" or c in _EDGE_COLUMNS)]
        e = edges.where("graph_id is not null and edge_id is not null and src is not null and dst is not null").selectExpr(*known, f"{_packed('edge_id')} as eid", *[f"{_packed(c)} as {c}" for c in ends if c in edges.columns])
        if candidates is None:
            c = nodes.sparkSession.createDataFrame([], "grp long, dst long, rank int")
        else:
            c = candidates.where("graph_id is not null and candidate_group is not null").selectExpr(f"{_packed('candidate_group')} as grp", f"{_packed('dst')} as dst", "rank")
            c = c if unique else c.distinct()
        return cls(n, e, c, unique)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> CodeGraph:
        return cls.of(table(spark, folder, "nodes"), table(spark, folder, "edges"), table(spark, folder, "candidates"))

    def at(self, graph_id: int) -> CodeGraph:
        """One graph of many."""
        n, e = self.raw_nodes.where(F.col("graph_id") == graph_id), self.raw_edges.where(F.col("graph_id") == graph_id)
        return CodeGraph(n, e, self.candidates.where(F.shiftright("grp", 32) == graph_id), self.unique)

    def _once(self, df: DataFrame) -> DataFrame:
        return df if self.unique else df.distinct()

    def node_rows(self, *columns: str, where: Column | None = None) -> DataFrame:
        """nid and the named columns of the nodes a condition admits, each node once."""
        x = self.raw_nodes if where is None else self.raw_nodes.where(where)
        return self._once(x.select("nid", *[c for c in columns if c != "nid"]))

    def edge_rows(self, *columns: str, where: Column | None = None) -> DataFrame:
        """eid and the named columns of the edges a condition admits, each edge once."""
        x = self.raw_edges if where is None else self.raw_edges.where(where)
        return self._once(x.select("eid", *[c for c in columns if c != "eid"]))

    @cached_property
    def nodes(self) -> DataFrame:
        """All columns of each node once; ask node_rows for some."""
        return self._once(self.raw_nodes)

    @cached_property
    def edges(self) -> DataFrame:
        """All columns of each edge once; ask edge_rows for some."""
        return self._once(self.raw_edges)

    @cached_property
    def group_sizes(self) -> DataFrame:
        """(candidate_group, size)"""
        return self.candidates.groupBy(F.col("grp").alias("candidate_group")).agg(F.count(F.lit(1)).alias("size"))

    def find(self, pattern: str) -> DataFrame:
        """nid, graph_id, fqn, kind, file and line_start of the nodes whose name matches a pattern."""
        return self.node_rows("graph_id", "fqn", "kind", "file", "line_start", where=matches(pattern, F.col("fqn")))

    def views(self, prefix: str = "") -> None:
        """Register the read views: v_symbols, v_call_edges (all edges), v_data_flow_edges, v_call_sites, v_provenance."""
        self.nodes.createOrReplaceTempView(f"{prefix}v_symbols")
        self.edges.createOrReplaceTempView(f"{prefix}v_call_edges")
        self.edges.where(F.col("kind") == "derives-from").createOrReplaceTempView(f"{prefix}v_data_flow_edges")
        self.edges.where(F.col("site_id").isNotNull()).select("graph_id", "site_id", F.col("src").alias("caller"), "stmt_index").distinct().createOrReplaceTempView(f"{prefix}v_call_sites")
        self.edges.select("eid", "graph_id", "edge_id", "tier", "rule", "confidence", "established_by").createOrReplaceTempView(f"{prefix}v_provenance")


def kind_order(c: Column) -> Column:
    return ordinal(c, EDGE_KINDS)


def confidence_rank(c: Column) -> Column:
    return ordinal(c, CONFIDENCES)


def condition_rank(c: Column) -> Column:
    return ordinal(c, CONDITIONS)
