"""Linking: names of references to definitions, over all files at once.

The rules form a ladder; each is a join over what is still open, and what it settles is taken off before the next. From sure to
vague: definitions in the enclosing scopes, imports, methods of that name for calls on a receiver, any callable of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import CodeGraph, kind_order
from ..model import CALLABLE
from ..operators import hierarchy
from ..session import cut
from .facts import Facts
from .numbering import dense_order

# Kinds of references and the edges they become.
EDGE_OF = {
    "Call": "calls", "CallVirtualReceiver": "calls-virtual", "CallClosure": "calls-closure", "CallPinnedClosure": "calls-closure", "CallCallback": "calls-callback", "CallAsync": "calls-async", "Spawn": "spawns", "Reference": "references", "Instantiate": "instantiates",
}
INDIRECT = ("CallClosure", "CallPinnedClosure", "CallCallback")
LOCALITY = ("same-file", "same-module", "same-crate", "global")


@dataclass(frozen=True)
class Options:
    arity_filter: bool = True
    name_arity: bool = True
    #: Whether a call on a receiver whose type is plain is linked to that type's method alone.
    receivers: bool = False


def _short(fqn: Column) -> Column:
    return F.element_at(F.split(fqn, "::"), -1)


def _parent(fqn: Column) -> Column:
    return F.regexp_extract(fqn, r"^(.*)::[^:]*$", 1)


def locality(file: Column, fqn: Column, other_file: Column, other_fqn: Column) -> Column:
    """How near a definition is to a caller, as a place in LOCALITY."""
    first = lambda c: F.element_at(F.split(c, "::"), 1)
    return F.when(file == other_file, 0).when(_parent(fqn) == _parent(other_fqn), 1).when(first(fqn) == first(other_fqn), 2).otherwise(3)


def build_nodes(facts: Facts) -> DataFrame:
    """Definitions as nodes; ids are dense in the order (file, line, name). A definition given twice stays twice, as overloads do."""
    n = facts.defs.select(
        F.col("kind"), "fqn", F.col("path").alias("file"), F.col("line").alias("line_start"), F.coalesce("line_end", "line").alias("line_end"), "lang", F.coalesce("visibility", F.lit("public")).alias("visibility"),
        F.coalesce("is_abstract", F.lit(False)).alias("is_abstract"), "entrypoint_kind", "signature", F.coalesce("own_effects", F.lit(0)).alias("own_effects"), F.coalesce("own_effects", F.lit(0)).alias("transitive_effects"), "arity", "scope",
    )
    return cut(dense_order(n, "node_id", "file", "line_start", "fqn"))


def scope_chains(facts: Facts) -> DataFrame:
    """(path, scope, ancestor, dist): each scope with itself and all scopes around it."""
    s = facts.scopes.select("path", "scope", "parent").distinct()
    tree = hierarchy.hierarchy(s, s, group="path", parent="parent", child="scope", node="scope")
    own = tree.select(F.col("g").alias("path"), F.col("node").alias("scope"), F.col("node").alias("ancestor"), F.lit(0).alias("dist"))
    up = hierarchy.descendants(tree).select(F.col("g").alias("path"), F.col("node").alias("scope"), "ancestor", F.col("distance").alias("dist"))
    return cut(own.unionByName(up))


def link(facts: Facts, options: Options = Options()) -> CodeGraph:
    """The linked graph of all facts.

    References outside any definition stand for no edge. What no rule settles is counted on its caller as an unresolved call.
    """
    nodes = build_nodes(facts)
    chains = scope_chains(facts)
    owners = chains.join(facts.scopes.where(F.col("owner_fqn").isNotNull()).select("path", F.col("scope").alias("ancestor"), "owner_fqn"), ["path", "ancestor"])
    owner = owners.groupBy("path", "scope").agg(F.min_by("owner_fqn", "dist").alias("caller_fqn"))
    by_file = nodes.groupBy(F.col("file").alias("path"), F.col("fqn").alias("caller_fqn")).agg(F.min("node_id").alias("src"))
    by_fqn = nodes.groupBy("fqn").agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("n"))
    short = nodes.select("node_id", "fqn", "file", "lang", "kind", "arity", "scope", _short(F.col("fqn")).alias("short"))

    refs = facts.refs.where(F.size("name_path") > 0).join(owner, ["path", "scope"]).join(by_file, ["path", "caller_fqn"])
    site = F.xxhash64("path", "line", "col", F.array_join("name_path", "::"), "ref_kind", "stmt_index")
    refs = refs.withColumn("last", F.element_at("name_path", -1)).withColumn("head", F.element_at("name_path", 1)).withColumn("single", F.size("name_path") == 1).withColumn("virtual", F.col("ref_kind") == "CallVirtualReceiver")
    todo = cut(refs.withColumn("ref", site).dropDuplicates(["ref"]))
    settled: list[DataFrame] = []

    def settle(hits: DataFrame, rule: Column, confidence: Column, tier: int) -> None:
        """hits: (ref, dst[, rank_key]); one target is an edge alone, several are a candidate set."""
        nonlocal todo
        if "near" not in hits.columns:
            hits = hits.withColumn("near", F.lit(0))
        hits = hits.groupBy("ref", "dst").agg(F.min("near").alias("near"))
        size = F.count(F.lit(1)).over(W.partitionBy("ref"))
        rank = F.row_number().over(W.partitionBy("ref").orderBy("near", "dst")) - 1
        x = cut(hits.withColumn("size", size).withColumn("rank", rank).select("ref", "dst", "size", "rank", rule.alias("rule"), confidence.alias("confidence"), F.lit(tier).cast("tinyint").alias("tier")))
        settled.append(x)
        todo = cut(todo.join(x.select("ref").distinct(), "ref", "left_anti"), drop=todo)

    # definitions of that name in the scopes around, the nearest first
    def lexical(r: DataFrame) -> DataFrame:
        local = short.where(F.col("scope").isNotNull()).select(F.col("file").alias("path"), F.col("scope").alias("ancestor"), F.col("short").alias("last"), "fqn")
        near = r.select("ref", "path", "scope", "last").join(chains, ["path", "scope"]).join(local, ["path", "ancestor", "last"])
        return near.groupBy("ref").agg(F.min_by("fqn", F.struct("dist", "fqn")).alias("fqn")).join(by_fqn, "fqn")

    pinned = lexical(todo.where((F.col("ref_kind") == "CallPinnedClosure") & F.col("single"))).where(F.col("n") == 1)
    settle(pinned.select("ref", F.col("node_id").alias("dst")), F.lit("scope-ref"), F.lit("certain"), 1)
    open_ = todo.where(F.col("ref_kind").isin(*INDIRECT)).select("ref", F.col("src").alias("dst"), F.coalesce(F.col("arity").cast("string"), F.lit("?")).alias("a"))
    settled.append(cut(open_.select("ref", "dst", F.lit(1).alias("size"), F.lit(0).alias("rank"), F.concat(F.lit("indirect:"), "a").alias("rule"), F.lit("possible").alias("confidence"), F.lit(0).cast("tinyint").alias("tier"))))
    todo = cut(todo.where(~F.col("ref_kind").isin(*INDIRECT)), drop=todo)
    settle(lexical(todo.where(F.col("single") & ~F.col("virtual"))).select("ref", F.col("node_id").alias("dst")), F.lit("scope-ref"), F.lit("certain"), 1)

    binding = facts.imports.select("path", F.col("scope").alias("ancestor"), F.col("local").alias("head"), "specifier", "exported").distinct()
    bound = todo.select("ref", "path", "scope", "head", "last", "name_path").join(chains, ["path", "scope"]).join(binding, ["path", "ancestor", "head"])
    bound = bound.groupBy("ref").agg(F.min_by(F.struct("specifier", "exported", "last", "name_path"), F.struct("dist", "specifier")).alias("x")).select("ref", "x.*")
    # a.b.f with a bound to module m is m::b::f; f bound to m's g is m::g
    tail = F.when(F.size("name_path") > 1, F.concat_ws("::", F.slice("name_path", F.lit(2), F.size("name_path") - 1)))
    wanted = bound.select("ref", F.concat_ws("::", "specifier", "exported", tail).alias("fqn"))
    exact = wanted.join(nodes.select("fqn", "node_id"), "fqn").select("ref", F.col("node_id").alias("dst"))
    settle(exact, F.lit("import-ref"), F.when(F.col("size") == 1, "probable").otherwise("possible"), 1)

    if options.receivers:
        for rule in ("recv-self", "recv-ctor"):
            settle(_member_of(_receiver_types(rule, facts, todo, nodes), facts, nodes), F.lit(rule), F.when(F.col("size") == 1, "probable").otherwise("possible"), 1)

    methods = short.where(F.col("kind") == "method").select("lang", F.col("short").alias("last"), F.col("node_id").alias("dst"))
    settle(todo.where("virtual").join(methods, ["lang", "last"]).select("ref", "dst"), F.lit("name-method"), F.when(F.col("size") == 1, "probable").otherwise("possible"), 1)

    if options.name_arity:
        named = short.where(F.col("kind").isin(*CALLABLE, "type")).select("lang", F.col("short").alias("last"), F.col("node_id").alias("dst"), F.col("file").alias("dst_file"), F.col("fqn").alias("dst_fqn"), F.col("arity").alias("dst_arity"))
        hits = todo.join(named, ["lang", "last"])
        if options.arity_filter:
            fits = F.col("arity").isNull() | F.col("dst_arity").isNull() | (F.col("arity") == F.col("dst_arity"))
            hits = hits.withColumn("fits", fits).withColumn("any", F.max("fits").over(W.partitionBy("ref"))).where(F.col("fits") | ~F.col("any"))
        hits = hits.select("ref", "dst", locality(F.col("path"), F.col("caller_fqn"), F.col("dst_file"), F.col("dst_fqn")).alias("near"))
        near = cut(hits)
        settle(near, F.lit("name-arity"), F.lit("possible"), 0)
        tagged = settled[-1].join(near.groupBy("ref", "dst").agg(F.min("near").alias("near")), ["ref", "dst"])
        settled[-1] = tagged.withColumn("rule", F.concat(F.lit("name-arity:loc:"), F.get(F.array(*[F.lit(x) for x in LOCALITY]), F.col("near")))).drop("near")

    done = settled[0]
    for x in settled[1:]:
        done = done.unionByName(x)
    kinds = F.element_at(F.create_map(*[F.lit(v) for kv in EDGE_OF.items() for v in kv]), F.col("ref_kind"))
    base = refs.withColumn("ref", site).dropDuplicates(["ref"]).select("ref", "src", kinds.alias("kind"), F.coalesce("condition", F.lit("always")).alias("condition"), "stmt_index", F.coalesce("cut_markers", F.array().cast("array<string>")).alias("cut_markers"))
    edges = done.join(base, "ref").select("src", "dst", "kind", "condition", "confidence", "tier", "rule", F.col("ref").alias("site_id"), "stmt_index", "cut_markers", F.when(F.col("size") > 1, F.col("ref")).alias("grp"), "rank")
    edges = cut(edges.unionByName(_relations(facts, nodes, by_fqn, short), allowMissingColumns=True))
    groups = dense_order(edges.where(F.col("grp").isNotNull()).select("grp").distinct(), "candidate_group", "grp")
    edges = edges.join(groups, "grp", "left")
    candidates = edges.where(F.col("grp").isNotNull()).select("candidate_group", "dst", "rank")
    numbered = dense_order(edges.withColumn("ko", kind_order(F.col("kind"))), "edge_id", "src", "dst", "ko", "stmt_index", "candidate_group", "site_id")
    lost = todo.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).cast("int").alias("unresolved_calls"))
    none = lambda t: F.lit(None).cast(t)
    full = nodes.join(lost, "node_id", "left").select(
        "node_id", "kind", "fqn", "file", "line_start", "line_end", "lang", "visibility", "is_abstract", "entrypoint_kind", "signature", "own_effects", "transitive_effects", F.coalesce("unresolved_calls", F.lit(0)).alias("unresolved_calls"), F.lit(0).alias("external_calls"),
        F.struct(*[F.lit(0).alias(c) for c in ("typed_out", "interproc_out", "visible_out", "visible_dropped_out", "typed_away_in", "interproc_away_in", "visible_away_in")]).alias("narrowing"),
    )
    out = numbered.select("edge_id", "src", "dst", "kind", "condition", "confidence", "tier", "rule", "site_id", "stmt_index", "cut_markers", none("string").alias("implicit"), "candidate_group", none("string").alias("established_by"), none("string").alias("cfg_condition"), none("string").alias("macro_origin"), none("string").alias("transform"))
    return CodeGraph.of(cut(full), cut(out), cut(candidates))


def _receiver_types(rule: str, facts: Facts, todo: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, type, last): open calls whose receiver has a plain type by a rule.

    recv-self: the receiver is the method's own object. recv-ctor: it is a local that is only ever made by calling one type of that name.
    """
    calls = todo.where(F.col("virtual") & (F.size("name_path") == 2)).select("ref", "head", "last", "caller_fqn")
    types = nodes.where(F.col("kind") == "type").select(F.col("fqn").alias("type"), _short(F.col("fqn")).alias("name"))
    if rule == "recv-self":
        own = calls.where(F.col("head").isin("self", "this", "cls")).withColumn("type", _parent(F.col("caller_fqn")))
        return own.join(types.select("type").distinct(), "type", "left_semi").select("ref", "type", "last")
    alone = types.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("type")).where(F.col("n") == 1)
    writes = facts.flows.groupBy(F.col("fn").alias("caller_fqn"), F.col("derived").alias("head")).agg(F.count_distinct(F.coalesce("callee", F.lit(""))).alias("ways"), F.max("callee").alias("callee"))
    made = writes.where((F.col("ways") == 1) & F.col("callee").isNotNull()).withColumn("name", _short(F.col("callee"))).join(alone.select("name", "type"), "name")
    return calls.join(made, ["caller_fqn", "head"]).select("ref", "type", "last")


def _member_of(types: DataFrame, facts: Facts, nodes: DataFrame) -> DataFrame:
    """(ref, dst): the method of that name in the type, or in the nearest type it inherits from (by last segment), however far up."""
    has = nodes.where(F.col("kind") == "method").select(_parent(F.col("fqn")).alias("type"), _short(F.col("fqn")).alias("last"), F.col("node_id").alias("dst"))
    up = facts.relations.where(F.col("relation").isin("Inherits", "Implements")).select(F.array_join("subject", "::").alias("type"), F.element_at("object", -1).alias("name")).distinct()
    every = nodes.where(F.col("kind") == "type").select(F.col("fqn").alias("next"), _short(F.col("fqn")).alias("name"))
    step = cut(up.join(every, "name").select("type", "next").distinct())
    at, found = cut(types), []
    seen = at.select("ref", "type")
    while True:
        hit = cut(at.join(has, ["type", "last"]).select("ref", "dst"))
        found.append(hit)
        # types that were asked before are not asked again, so that circles of bases end
        at = cut(at.join(hit.select("ref").distinct(), "ref", "left_anti").join(step, "type").select("ref", F.col("next").alias("type"), "last").distinct().join(seen, ["ref", "type"], "left_anti"))
        if at.isEmpty():
            break
        seen = cut(seen.unionByName(at.select("ref", "type")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _relations(facts: Facts, nodes: DataFrame, by_fqn: DataFrame, short: DataFrame) -> DataFrame:
    """implements, inherits and overrides edges; a name that fits no or several definitions gives none."""
    kind = F.element_at(F.create_map(*[F.lit(v) for kv in (("Implements", "implements"), ("Inherits", "inherits"), ("Overrides", "overrides")) for v in kv]), F.col("relation"))
    rule = F.element_at(F.create_map(*[F.lit(v) for kv in (("Implements", "impl-relation"), ("Inherits", "supertrait"), ("Overrides", "trait-override")) for v in kv]), F.col("relation"))
    r = facts.relations.withColumn("rid", F.xxhash64("path", "relation", F.array_join("subject", "::"), F.array_join("object", "::"))).dropDuplicates(["rid"])
    r = cut(r.select("rid", kind.alias("kind"), rule.alias("rule"), F.array_join("subject", "::").alias("s"), F.array_join("object", "::").alias("o"), (F.col("relation") == "Overrides").alias("member")))

    def only(side: str, member: bool) -> DataFrame:
        """(rid, node_id): the definition a name means: exact, else the only one with this last segment (for members: these two)."""
        kinds = ("method", "function") if member else ("type",)
        x = r.where(F.col("member") == member).select("rid", F.col(side).alias("name"))
        k = nodes.where(F.col("kind").isin(*kinds)).select("fqn", "node_id")
        exact = x.join(k, x["name"] == k["fqn"]).groupBy("rid").agg(F.min("node_id").alias("node_id"))
        tail = lambda c: F.regexp_extract(c, r"([^:]+::[^:]+)$" if member else r"([^:]+)$", 1)
        loose = x.join(exact, "rid", "left_anti").withColumn("t", tail(F.col("name"))).where(F.col("t") != "").join(k.withColumn("t", tail(F.col("fqn"))), "t")
        loose = loose.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id")).where(F.col("n") == 1).drop("n")
        return exact.unionByName(loose)

    ends = {side: only(side, False).unionByName(only(side, True)) for side in ("s", "o")}
    x = r.join(ends["s"].withColumnRenamed("node_id", "src"), "rid").join(ends["o"].withColumnRenamed("node_id", "dst"), "rid")
    return x.select("src", "dst", "kind", F.lit("always").alias("condition"), F.lit("certain").alias("confidence"), F.lit(1).cast("tinyint").alias("tier"), "rule", F.array().cast("array<string>").alias("cut_markers"), F.lit(None).cast("bigint").alias("grp"), F.lit(0).alias("rank"))
