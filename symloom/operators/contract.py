"""What an answer leaves out or may have too much of: reasons, freshness, assertions.

The facts behind the reasons are one aggregate over the nodes a walk touched and the edges at them; nothing is computed before it
is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph, confidence_rank
from ..model import CALL_FAMILY, CONFIDENCES
from . import walk
from .filters import EdgeFilter

# Codes of the reasons. Cut markers have a code each.
CUT_CODES = {
    "unresolved": "unresolved-call", "dynamic": "dynamic-dispatch", "reflective": "reflective-dispatch", "via-ffi": "foreign-function", "via-di": "dependency-injection", "unexpanded-macro": "unexpanded-macro", "opaque-call": "opaque-dataflow",
    "truncated-access-path": "truncated-access-path", "summary-budget-exceeded": "summary-budget", "external": "external-receiver", "untyped-receiver": "untyped-receiver",
}
FORWARD_COUNTERS = {"unresolved_calls": "unresolved-external-calls", "external_calls": "external-receiver-calls", "typed_out": "receiver-narrowed", "interproc_out": "receiver-narrowed-interproc", "visible_out": "residual-import-visible"}
BACKWARD_COUNTERS = {"typed_away_in": "receiver-narrowed-away", "interproc_away_in": "receiver-narrowed-away-interproc", "visible_away_in": "residual-narrowed-away"}
OVER = frozenset(("over-approx-candidate-set",))


@dataclass(frozen=True)
class Reason:
    code: str
    direction: str  # over or under
    count: int


@dataclass(frozen=True)
class Contract:
    reasons: tuple[Reason, ...] = ()
    #: What was searched, for an answer with no rows.
    scope: dict | None = None

    @property
    def approximation(self) -> str:
        sides = {r.direction for r in self.reasons}
        return "exact" if not sides else "over_under" if len(sides) == 2 else sides.pop()


def frontier(g: CodeGraph, subject: DataFrame, forward: bool, depth: int | None, admit: EdgeFilter = EdgeFilter()) -> DataFrame:
    """One row of counts over the subject and what it reaches.

    Edges at these nodes count by their cut markers, as below the floor of confidence, or as parts of too large a candidate set; dangling calls
    of the nodes count on forward walks over calls alone. Counters of narrowing don't count at the depth limit, as nothing is followed from there.
    `horizon` tells whether an admitted edge leads on from there.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    got = walk.bfs(walk.oriented(admit.raw(g), forward), subject, depth)
    touched = got.select("node", "depth").unionByName(subject.select("node", F.lit(0).alias("depth"))).groupBy("node").agg(F.min("depth").alias("depth"))
    inside = F.lit(True) if depth is None else F.col("depth") < depth
    calls = set(admit.kinds or CALL_FAMILY) <= set(CALL_FAMILY)
    n = touched.join(g.node_rows("unresolved_calls", "external_calls", "narrowing").select(F.col("nid").alias("node"), "unresolved_calls", "external_calls", "narrowing.*"), "node")
    counters = [c for c in (*FORWARD_COUNTERS, *BACKWARD_COUNTERS, "visible_dropped_out")]
    take = {c: calls and (c in BACKWARD_COUNTERS) != forward for c in counters}
    nodes = n.agg(*[F.coalesce(F.sum(F.when(F.lit(True) if c == "unresolved_calls" else inside, F.coalesce(c, F.lit(0)))) if take[c] else F.lit(0), F.lit(0)).cast("long").alias(c) for c in counters])
    wide = replace(admit, confidence=None, max_candidates=None, only=(), exclude=()).apply(g, "src", "dst", "confidence", "cut_markers", "candidate_group").join(g.group_sizes, "candidate_group", "left")
    near = wide.join(touched.withColumnRenamed("node", a), a)
    floor = CONFIDENCES.index(admit.confidence) if admit.confidence else 0
    below = F.coalesce(confidence_rank(F.col("confidence")), F.lit(0)) < floor
    large = F.lit(False) if admit.max_candidates is None else ~below & (F.coalesce("size", F.lit(1)) > admit.max_candidates)
    edges = near.agg(
        *[F.count_if(F.array_contains("cut_markers", m)).alias("cut_" + m.replace("-", "_")) for m in CUT_CODES], F.count_if(below).alias("below_floor"), F.count_if(large).alias("dropped_max_candidates"),
        F.count_if(~below & F.col("candidate_group").isNotNull()).alias("candidate_edges"),
    )
    if depth is None:
        ahead = nodes.sparkSession.createDataFrame([(0,)], "horizon long")
    else:
        edge_of = admit.apply(g, "src", "dst").join(touched.where(F.col("depth") == depth).withColumnRenamed("node", a), a).join(touched.select(F.col("node").alias(b)), b, "left_anti")
        ahead = edge_of.agg(F.count(F.lit(1)).alias("horizon"))
    one = F.lit(1)
    return nodes.withColumn("k", one).join(edges.withColumn("k", one), "k").join(ahead.withColumn("k", one), "k").drop("k")  # single rows


def of_walk(g: CodeGraph, subject: DataFrame, forward: bool, depth: int | None, admit: EdgeFilter = EdgeFilter(), empty: bool = False) -> Contract:
    """The contract of callers, callees and the like."""
    x = frontier(g, subject, forward, depth, admit).first().asDict()
    reasons = []
    if x["candidate_edges"]:
        reasons.append(Reason("over-approx-candidate-set", "over", x["candidate_edges"]))
    x["visible_out"] += x["visible_dropped_out"]
    for column, code in {**FORWARD_COUNTERS, **BACKWARD_COUNTERS, **{"cut_" + m.replace("-", "_"): c for m, c in CUT_CODES.items()}, "below_floor": "below-confidence-floor", "dropped_max_candidates": "dropped-max-candidates"}.items():
        if x[column]:
            reasons.append(Reason(code, "under", x[column]))
    if x["horizon"]:
        reasons.append(Reason("depth-limit", "under", depth))
    return Contract(tuple(reasons), scope_of(depth, admit) if empty else None)


def scope_of(depth: int | None, admit: EdgeFilter) -> dict:
    return {"kinds": list(admit.kinds or CALL_FAMILY), "confidence": admit.confidence or CONFIDENCES[0], "depth": depth}


def of_unused(g: CodeGraph) -> Contract:
    """Unused code: every call that could not be followed makes the answer too large."""
    x = g.node_rows("unresolved_calls").agg(F.sum(F.coalesce("unresolved_calls", F.lit(0))).alias("n")).first()["n"] or 0
    cuts = g.edge_rows("cut_markers", where=F.col("kind").isin(*CALL_FAMILY)).select(F.explode("cut_markers").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).collect()
    reasons = [Reason("unresolved-external-calls", "over", x)] if x else []
    return Contract(tuple(reasons + sorted((Reason(CUT_CODES.get(r["m"], r["m"]), "over", r["n"]) for r in cuts), key=lambda r: r.code)))


def of_history(excluded_merges: int, excluded_roots: int, excluded_large: int) -> Contract:
    """Files that change together: commits that were left out make the answer too small."""
    parts = (("merge-commits-excluded", excluded_merges), ("root-commits-excluded", excluded_roots), ("oversized-commits-excluded", excluded_large))
    return Contract(tuple(Reason(c, "under", n) for c, n in parts if n))


@dataclass(frozen=True)
class Freshness:
    """How an index stands to the tree it answers for; nothing of the clock is in it."""

    indexed_tree: str
    head_tree: str | None = None
    dirty_files: int | None = None

    @property
    def matches_head(self) -> bool | None:
        return None if self.head_tree is None else self.indexed_tree == self.head_tree

    @property
    def stale(self) -> bool:
        return self.matches_head is False or bool(self.dirty_files)


@dataclass(frozen=True)
class Assertion:
    """Checks that an answer is empty. Exit codes: 0 fine, 1 failed, 4 empty only because nothing could be found."""

    assert_empty: bool = False
    allow_vacuous: bool = False

    def exit_code(self, rows: int, rows_unfiltered: int, any_symbol: bool) -> int:
        if not self.assert_empty:
            return 0
        if rows:
            return 1
        vacuous = not any_symbol or rows_unfiltered > 0
        return 4 if vacuous and not self.allow_vacuous else 0


EXIT_OK, EXIT_ASSERTION, EXIT_USAGE, EXIT_GRAPH, EXIT_VACUOUS = 0, 1, 2, 3, 4


@dataclass
class Answer:
    """Rows, and on request the contract."""

    rows: DataFrame
    contract: callable = field(default=lambda: Contract())


def of_paths(g: CodeGraph, subject: DataFrame, depth: int | None, found: int, cap: int | None, admit: EdgeFilter = EdgeFilter()) -> Contract:
    """The contract of paths: that of the walk, and whether the cap on paths was met."""
    c = of_walk(g, subject, True, depth, admit, not found)
    return replace(c, reasons=(*c.reasons, Reason("truncated-path-cap", "under", cap))) if cap is not None and found >= cap else c


def of_impacted(g: CodeGraph, reached: DataFrame) -> Contract:
    """Impacted tests: calls that stay open in code that was not reached may hide a test; reached is (nid)."""
    rest = g.node_rows("unresolved_calls", "external_calls").join(reached.select("nid").distinct(), "nid", "left_anti")
    x = rest.agg(F.sum(F.coalesce("unresolved_calls", F.lit(0))).alias("open"), F.sum(F.coalesce("external_calls", F.lit(0))).alias("out")).first()
    vague = g.edge_rows(where=F.col("kind").isin(*CALL_FAMILY) & F.col("candidate_group").isNotNull()).count()
    parts = (("impacted-unresolved-calls", "under", x["open"] or 0), ("impacted-external-calls", "under", x["out"] or 0), ("impacted-candidate-set", "over", vague))
    return Contract(tuple(Reason(*p) for p in parts if p[2]))
