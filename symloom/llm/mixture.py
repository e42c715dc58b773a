"""Mixing sources to target weights by min-cost flow over membership patterns.

Equal texts are one unit, whatever ids they come under. The units are aggregated by membership pattern, the set of listed
sources they occur in; each pattern offers its tokens once at no cost and again, up to its cap of repeats, at a cost that rises
with each repeat (convex). Flow runs from patterns to the quotas of their sources. The amounts routed are then cut out of the
pattern's texts in a seeded order.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

#: Folder of the public tokenizers, and the file used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: How that vocabulary splits text before merging. Fixed value of the vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Rows per block of the seeded order within a pattern.
BLOCK_ROWS = 50_000


def plain_source(source: Column) -> Column:
    """One spelling of a source: lower case, `-` for `_`, no blanks around."""
    return F.translate(F.lower(F.trim(source)), "_", "-")


def with_tokens(documents: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """documents with n_tokens, counted over the whole text; null for a null text."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoder = tiktoken.Encoding("units", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for x in texts:
            yield pd.Series([None if t is None else len(encoder.encode_ordinary(t)) for t in x], dtype="Int64")

    return documents.withColumn("n_tokens", count("text"))


def max_flow_min_cost(supply: list[tuple[frozenset, list[int]]], quota: dict[str, int]) -> list[dict[tuple[int, str], int]]:
    """Flow per supply: {(level, source): tokens}, the largest possible and among these the cheapest.

    supply: (sources, tokens offered at level 0, 1, ...); a token at level k costs k. As all costs lie on the arcs out of the start, the
    cheapest largest flow fills level by level: each level is a largest flow that keeps what lower levels already carry.
    """
    used = [dict() for _ in supply]  # source -> tokens, over all levels
    carries: dict[str, set[int]] = {s: set() for s in quota}  # source -> patterns with flow to it
    left = dict(quota)
    took: list[list[int]] = [[] for _ in supply]
    for level in range(max((len(o) for _, o in supply), default=0)):
        for i, (members, offered) in enumerate(supply):
            took[i].append(0)
            amount = offered[level] if level < len(offered) else 0
            while amount > 0:
                # breadth-first: this pattern -> source with room, over other patterns that can shift to another source
                came: dict = {}
                seen_s, seen_p, queue, end = set(), {i}, deque([i]), None
                while queue and end is None:
                    p = queue.popleft()
                    for s in sorted(supply[p][0]):
                        if s in seen_s or s not in left:
                            continue
                        seen_s.add(s)
                        came[s] = p
                        if left[s] > 0:
                            end = s
                            break
                        for q in sorted(carries[s] - seen_p):
                            seen_p.add(q)
                            came["p", q] = s
                            queue.append(q)
                if end is None:
                    break
                route, s = [], end
                while True:
                    p = came[s]
                    route.append((p, s))
                    if p == i:
                        break
                    s = came["p", p]
                flow = min([amount, left[end], *(used[p][came["p", p]] for p, _ in route[:-1])])
                for p, s in route:
                    used[p][s] = used[p].get(s, 0) + flow
                    carries[s].add(p)
                    if p != i:
                        used[p][came["p", p]] -= flow
                        if not used[p][came["p", p]]:
                            carries[came["p", p]].discard(p)
                left[end] -= flow
                amount -= flow
                took[i][level] += flow
    out = []
    for i in range(len(supply)):
        plan: dict[tuple[int, str], int] = {}
        rest = {s: n for s, n in sorted(used[i].items()) if n}
        for level, n in enumerate(took[i]):
            for s in list(rest):
                x = min(n, rest[s])
                if x:
                    plan[level, s] = x
                    n -= x
                    rest[s] -= x
                if not rest[s]:
                    del rest[s]
        out.append(plan)
    return out


def plan_mixture(patterns: list[tuple[frozenset, int]], share: dict[str, float], repeats: dict[str, int], total: int | None = None) -> tuple[int, list[dict[tuple[int, str], int]]]:
    """(total, flows): how many tokens of each pattern go to which source at which repeat.

    Sources without texts can reach no share; the others' shares are scaled to sum 1. Without `total`, the largest total is taken for
    which all these quotas can be met in full. A text may be used as often as the strictest of its sources allows.
    """
    have = {s for members, n in patterns if n for s in members}
    known = {s: w for s, w in share.items() if s in have and w > 0}
    scale = sum(known.values())
    supply = [(members, [n] * max(0, min(repeats[s] for s in members))) for members, n in patterns]
    if not known:
        return 0, [{} for _ in patterns]

    def solve(t: int):
        quota = {s: int(t * w / scale) for s, w in known.items()}
        flows = max_flow_min_cost(supply, quota)
        return flows, sum(sum(f.values()) for f in flows) == sum(quota.values())

    if total is None:
        low, high = 0, int(sum(sum(o) for _, o in supply)) + 1
        while high - low > max(1, low // 100_000):
            mid = (low + high) // 2
            if solve(mid)[1]:
                low = mid
            else:
                high = mid
        total = low
    return total, solve(total)[0]


def mixture(documents: DataFrame, weights: DataFrame, total: int | None = None, seed: int = 17, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(doc_id, source, n_tokens, uses): the texts of the mixture, for which source they stand and how often.

    A text is named by its smallest doc_id within the source. Null and empty texts, null and unlisted sources give no row; the weights'
    rows may repeat (the first by value counts); without weights or texts the result is empty. Other columns are ignored.
    weights is a table of sources, one row each: it and the patterns, sets of its sources, are brought to the driver.
    """
    spark = documents.sparkSession
    # rows of a configuration table, not of the corpus
    listed = weights.where(F.col("source").isNotNull() & F.col("target_share").isNotNull()).select(plain_source(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*").collect()
    share = {r["source"]: float(r["target_share"]) for r in listed}
    repeats = {r["source"]: int(r["max_repeats"]) for r in listed}

    docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", plain_source(F.col("source")).alias("source")).where(F.col("source").isin(*share) if share else F.lit(False))
    sized = with_tokens(docs, path).select("doc_id", "source", F.md5(F.encode("text", "UTF-8")).alias("text_id"), "n_tokens").where(F.col("n_tokens") > 0)
    copies = sized.groupBy("text_id", "source").agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"))
    units = copies.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("members"), F.min("n_tokens").alias("n_tokens"))
    units = cut(units.withColumn("pattern", F.array_join("members.source", "\n")).withColumn("h", F.xxhash64("text_id", F.lit(seed))))

    sums = units.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("pattern").collect()
    total, flows = plan_mixture([(frozenset(r["pattern"].split("\n")), r["n"]) for r in sums], share, repeats, total)
    pieces = []
    for r, flow in zip(sums, flows):
        at: dict[int, int] = {}
        for (level, s), n in sorted(flow.items()):
            a = at.get(level, 0)
            pieces.append((r["pattern"], level, s, a, a + n))
            at[level] = a + n
    plan = spark.createDataFrame(pieces, "pattern string, level int, source string, low long, high long")
    plan = plan.groupBy("pattern").agg(F.collect_list(F.struct("level", "source", "low", "high")).alias("pieces"))

    blocks = max(1, -(-max([r["rows"] for r in sums], default=0) // BLOCK_ROWS))
    placed = units.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    sizes = placed.groupBy("pattern", "block").agg(F.sum("n_tokens").alias("size"))
    start = sizes.select("pattern", "block", (F.sum("size").over(W.partitionBy("pattern").orderBy("block")) - F.col("size")).alias("start"))
    inside = F.sum("n_tokens").over(W.partitionBy("pattern", "block").orderBy("h", "text_id")) - F.col("n_tokens")
    placed = placed.withColumn("inside", inside).join(start, ["pattern", "block"]).withColumn("at", F.col("start") + F.col("inside"))
    placed = placed.join(plan, "pattern")
    # a text belongs to the piece that its middle lies in, so a quota is met to half a text at either border
    middle = 2 * F.col("at") + F.col("n_tokens")
    used = placed.select("members", "n_tokens", middle.alias("middle"), F.explode("pieces").alias("p")).where((F.col("middle") >= 2 * F.col("p.low")) & (F.col("middle") < 2 * F.col("p.high")))
    used = used.groupBy("members", "n_tokens", "p.source").agg(F.count(F.lit(1)).alias("uses"))
    doc = F.element_at(F.filter("members", lambda m: m["source"] == F.col("source")), 1)["doc_id"]
    return used.select(doc.alias("doc_id"), "source", "n_tokens", F.col("uses").cast("int").alias("uses"))


def reached(mix: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, share, n_tokens, n_texts, most_uses) for each listed source, 0 where it has no texts."""
    listed = weights.where(F.col("source").isNotNull()).select(plain_source(F.col("source")).alias("source"), "target_share").groupBy("source").agg(F.min("target_share").alias("target_share"))
    per = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("uses").alias("most_uses"))
    full = listed.join(per, "source", "left").fillna(0, ["n_tokens", "n_texts", "most_uses"])
    # a row per listed source
    every = F.sum("n_tokens").over(W.partitionBy())
    return full.select("source", "target_share", F.when(every > 0, F.col("n_tokens") / every).otherwise(F.lit(0.0)).alias("share"), "n_tokens", "n_texts", "most_uses")
