"""Which edges a walk may use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..model import CALL_FAMILY, CONFIDENCES


@dataclass(frozen=True)
class EdgeFilter:
    """kinds: none means the call family. confidence: a floor; an edge without confidence is below every floor but none.
    only, exclude: conditions. max_candidates: size of the candidate set up to which an edge counts; an edge without one has size 1."""

    kinds: tuple[str, ...] = ()
    confidence: str | None = None
    only: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_candidates: int | None = None

    def raw(self, g: CodeGraph) -> DataFrame:
        """Admitted edges with all columns; exact duplicates may be among them, as walks don't mind."""
        e = g.raw_edges.where(F.col("kind").isin(*(self.kinds or CALL_FAMILY)))
        if self.confidence and self.confidence != CONFIDENCES[0]:
            e = e.where(F.col("confidence").isin(*CONFIDENCES[CONFIDENCES.index(self.confidence) :]))
        if self.only:
            e = e.where(F.col("condition").isin(*self.only))
        if self.exclude:
            e = e.where(~F.col("condition").isin(*self.exclude))
        if self.max_candidates is not None:
            e = e.join(g.group_sizes, "candidate_group", "left").where(F.coalesce("size", F.lit(1)) <= self.max_candidates).drop("size")
        return e

    def apply(self, g: CodeGraph, *columns: str) -> DataFrame:
        """Admitted edges, each once: eid and the named columns, or all."""
        e = self.raw(g)
        e = e.select("eid", *[c for c in columns if c != "eid"]) if columns else e
        return e if g.unique else e.distinct()
