"""Passes over a linked graph: class hierarchy, instantiated types, closures of one arity, effects, data flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import short_name
from ..graph import CodeGraph
from ..model import CALL_FAMILY
from ..operators import walk
from ..operators.ask import entrypoints
from ..operators.filters import EdgeFilter
from ..session import cut
from .numbering import dense_order

#: A candidate set beyond this is kept whole but marked as unresolved.
SUPERNODE = 64


def owner(fqn: Column) -> Column:
    """The name a member stands in: everything before the last segment."""
    return F.regexp_extract(fqn, r"^(.*)::[^:]*$", 1)


def effect_closure(g: CodeGraph) -> DataFrame:
    """(nid, transitive_effects): own effects and those of all that is called; effects don't cross spawns.

    Each effect walks backward from the nodes that have it, all effects at once; nodes on a circle share theirs by themselves.
    """
    steps = walk.oriented(EdgeFilter(kinds=CALL_FAMILY[:6]).raw(g), False)
    bits = g.raw_nodes.where(F.col("own_effects") > 0).select(F.col("nid").alias("node"), F.explode(F.expr("filter(transform(sequence(0, 15), i -> int(shiftleft(1, i))), b -> (own_effects & b) > 0)")).alias("root"))
    got = walk.reached(steps, bits.select(F.col("root").cast("long").alias("root"), "node"), by_root=True)
    return g.node_rows().join(got.groupBy(F.col("node").alias("nid")).agg(F.bit_or("root").cast("int").alias("x")), "nid", "left").select("nid", F.coalesce("x", F.lit(0)).alias("transitive_effects"))


def with_effects(g: CodeGraph) -> CodeGraph:
    return CodeGraph(g.nodes.drop("transitive_effects").join(effect_closure(g), "nid"), g.edges, g.candidates)


def supertypes(g: CodeGraph) -> DataFrame:
    """(sub, super): each type with the traits or classes it implements or inherits, through any number of steps, and itself."""
    e = g.raw_edges.where(F.col("kind").isin("implements", "inherits"))
    steps = walk.oriented(e)
    types = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return walk.reached(steps, types.select(F.col("node").alias("root"), "node"), by_root=True).select(F.col("root").alias("sub"), F.col("node").alias("super"))


def cha_targets(g: CodeGraph) -> DataFrame:
    """(graph_id, method, dst): for each method name the bodies a call on some declaring type can run.

    A type that takes part in the hierarchy and declares the method makes every type below it a candidate: with its own body, else with
    the declaring type's, unless that is abstract.
    """
    up = cut(supertypes(g))
    own = g.node_rows("graph_id", "fqn", "is_abstract", where=F.col("kind").isin("method", "function")).select("graph_id", F.col("nid").alias("body"), short_name(F.col("fqn")).alias("method"), owner(F.col("fqn")).alias("type"), "is_abstract")
    types = g.raw_nodes.where(F.col("kind") == "type").groupBy("graph_id", F.col("fqn").alias("type")).agg(F.min("nid").alias("t"))
    has = cut(own.join(types, ["graph_id", "type"]).select("graph_id", "t", "method", "body", "is_abstract"))
    declared = has.join(up.select(F.col("super").alias("t")).distinct(), "t", "left_semi")
    below = declared.select("graph_id", "method", F.col("t").alias("super"), F.col("body").alias("default"), "is_abstract").join(up, "super")
    bodies = below.join(has.select(F.col("t").alias("sub"), "method", F.col("body").alias("mine"), F.col("is_abstract").alias("mine_abstract")), ["sub", "method"], "left")
    dst = F.when(F.col("mine").isNotNull() & ~F.col("mine_abstract"), F.col("mine")).when(F.col("mine").isNull() & ~F.col("is_abstract"), F.col("default"))
    return bodies.select("graph_id", "method", dst.alias("dst")).where(F.col("dst").isNotNull()).distinct()


def _renumbered(g: CodeGraph, edges: DataFrame) -> CodeGraph:
    """edges with groups by `grp` (any long) as a graph; ids are in the canonical order within each graph.

    Rows are ranged in that order and numbered by partition; a graph's first number is taken off, so a large graph is spread over many tasks.
    """
    from ..graph import kind_order

    e = edges.withColumn("__k", kind_order(F.col("kind"))).withColumn("__s", F.coalesce("stmt_index", F.lit(2**31 - 1))).withColumn("__g", F.coalesce("grp", F.lit(2**63 - 1)))
    e = dense_order(e, "__no", "graph_id", "src", "dst", "__k", "__s", "__g", "site_id", "rule")
    first = e.groupBy("graph_id").agg(F.min("__no").alias("__first"))
    e = e.join(first, "graph_id").withColumn("edge_id", (F.col("__no") - F.col("__first")).cast("int")).withColumn("eid", F.shiftleft(F.col("graph_id").cast("long"), 32) + F.col("edge_id"))
    e = cut(e.drop("__k", "__s", "__g", "__no", "__first").withColumn("candidate_group", F.col("grp")))
    ranked = e.where(F.col("grp").isNotNull()).select("grp", "dst", (F.row_number().over(W.partitionBy("grp").orderBy("dst")) - 1).alias("rank"))
    return CodeGraph(g.nodes, e.drop("grp"), cut(ranked))


def cha(g: CodeGraph) -> CodeGraph:
    """Calls on a receiver that were linked by method name alone get the bodies the class hierarchy allows.

    One site is one caller and site id; a method no declaring type knows stays as it is. One target is probable, several are possible.
    """
    sites = g.raw_edges.where((F.col("kind") == "calls-virtual") & (F.col("rule") == "name-method") & F.col("site_id").isNotNull())
    first = sites.groupBy("graph_id", "src", "site_id").agg(F.min(F.struct("eid", "dst")).alias("x")).select("graph_id", "src", "site_id", F.col("x.eid").alias("eid"), F.col("x.dst").alias("first"))
    named = first.join(g.node_rows("fqn").select(F.col("nid").alias("first"), short_name(F.col("fqn")).alias("method")), "first").drop("first")
    hits = cut(named.join(cha_targets(g), ["graph_id", "method"]))
    if hits.isEmpty():
        return g
    size = F.count(F.lit(1)).over(W.partitionBy("graph_id", "src", "site_id"))
    proto = g.edges.drop("dst", "confidence", "tier", "rule", "candidate_group", "edge_id")
    new = hits.withColumn("size", size).select("eid", "dst", "size").join(proto, "eid")
    new = new.withColumn("confidence", F.when(F.col("size") == 1, "probable").otherwise("possible")).withColumn("tier", F.lit(3).cast("tinyint")).withColumn("rule", F.lit("cha-trait-set"))
    new = new.withColumn("grp", F.when(F.col("size") > 1, F.xxhash64("graph_id", "src", "site_id"))).withColumn("cut_markers", F.when(F.col("size") > SUPERNODE, F.array_union("cut_markers", F.array(F.lit("unresolved")))).otherwise(F.col("cut_markers")))
    kept = g.edges.join(hits.select("graph_id", "src", "site_id").distinct().withColumn("gone", F.lit(True)), ["graph_id", "src", "site_id"], "left")
    kept = kept.where(F.col("gone").isNull() | (F.col("rule") != "name-method")).drop("gone").withColumn("grp", F.col("candidate_group"))
    columns = [c for c in g.edges.columns if c not in ("edge_id", "eid", "candidate_group")]
    return _renumbered(g, kept.select(*columns, "grp").unionByName(new.select(*columns, "grp")))


def rta(g: CodeGraph) -> CodeGraph:
    """Targets of the hierarchy pass whose type is never made in code that runs are dropped, if others remain; these become probable.

    Code that runs is what entry points reach, or all callables without one. Nothing is dropped in a graph where such code has a cut on a
    construction, nor at a site with a cut.
    """
    roots = entrypoints(g).withColumn("graph_id", F.shiftright("nid", 32).cast("int"))
    without = g.raw_nodes.where(F.col("kind").isin("function", "method", "lambda")).join(roots.select("graph_id").distinct(), "graph_id", "left_anti").select("nid")
    live = cut(walk.reached(walk.oriented(EdgeFilter().raw(g)), roots.select("nid").unionByName(without).select(F.col("nid").alias("node"))))
    made = g.raw_edges.where(F.col("kind") == "instantiates").join(live.withColumnRenamed("node", "src"), "src", "left_semi")
    cut_graphs = made.where(F.size("cut_markers") > 0).select("graph_id").distinct().withColumn("cut", F.lit(True))
    types = made.join(g.raw_nodes.select(F.col("nid").alias("dst"), F.col("fqn").alias("type")), "dst").select("graph_id", "type").distinct().withColumn("made", F.lit(True))
    s = g.edge_rows("graph_id", "src", "dst", "site_id", "cut_markers", where=(F.col("rule") == "cha-trait-set") & F.col("site_id").isNotNull())
    s = s.join(g.node_rows("fqn").select(F.col("nid").alias("dst"), owner(F.col("fqn")).alias("type")), "dst")
    s = s.join(types, ["graph_id", "type"], "left").join(cut_graphs, "graph_id", "left")
    site = W.partitionBy("graph_id", "src", "site_id")
    keep = F.coalesce("made", F.lit(False)) | (F.col("type") == "")
    s = s.withColumn("keep", keep).withColumn("n_keep", F.count_if(F.col("keep")).over(site)).withColumn("n", F.count(F.lit(1)).over(site)).withColumn("cuts", F.max(F.size("cut_markers")).over(site))
    pruned = s.where(F.col("cut").isNull() & (F.col("cuts") == 0) & (F.col("n_keep") > 0) & (F.col("n_keep") < F.col("n")))
    verdict = cut(pruned.select("eid", "keep", F.col("n_keep").alias("left_over")))
    e = g.edges.join(verdict, "eid", "left").where(F.coalesce("keep", F.lit(True)))
    up = F.col("keep").isNotNull()
    e = e.withColumn("confidence", F.when(up, "probable").otherwise(F.col("confidence"))).withColumn("rule", F.when(up, "rta-pruned").otherwise(F.col("rule"))).withColumn("grp", F.when(up & (F.col("left_over") == 1), F.lit(None)).otherwise(F.col("candidate_group")))
    columns = [c for c in g.edges.columns if c not in ("edge_id", "eid", "candidate_group")]
    return _renumbered(g, e.select(*columns, "grp"))


def signature_match(g: CodeGraph) -> CodeGraph:
    """Calls through a value (rule indirect:<n>) get all closures and free functions of their language with n parameters; ? fits any."""
    n_params = F.size("signature.params")
    targets = g.node_rows("graph_id", "lang", "signature", where=F.col("kind").isin("lambda", "function")).select("graph_id", "lang", F.when(F.col("signature").isNotNull(), n_params).alias("n"), F.col("nid").alias("to"))
    holes = g.edge_rows("graph_id", "src", "rule", where=F.col("rule").startswith("indirect:")).join(g.node_rows("lang").withColumnRenamed("nid", "src"), "src").withColumn("want", F.element_at(F.split("rule", ":"), 2))
    exact = holes.where(F.col("want") != "?").join(targets.withColumn("want", F.col("n").cast("string")), ["graph_id", "lang", "want"]).select("eid", "to")
    loose = holes.where(F.col("want") == "?").join(targets, ["graph_id", "lang"]).select("eid", "to")
    hits = cut(exact.unionByName(loose))
    size = F.count(F.lit(1)).over(W.partitionBy("eid"))
    proto = g.edges.drop("dst", "confidence", "tier", "rule", "candidate_group", "edge_id")
    new = hits.withColumn("size", size).join(proto, "eid").withColumnRenamed("to", "dst").withColumn("confidence", F.lit("possible")).withColumn("tier", F.lit(0).cast("tinyint")).withColumn("rule", F.lit("sig-compat"))
    new = new.withColumn("grp", F.when(F.col("size") > 1, F.xxhash64("eid", F.lit("sig")))).withColumn("cut_markers", F.when(F.col("size") > SUPERNODE, F.array_union("cut_markers", F.array(F.lit("unresolved")))).otherwise(F.col("cut_markers")))
    kept = g.edges.join(hits.select("eid").distinct(), "eid", "left_anti").withColumn("grp", F.col("candidate_group"))
    columns = [c for c in g.edges.columns if c not in ("edge_id", "eid", "candidate_group")]
    return _renumbered(g, kept.select(*columns, "grp").unionByName(new.select(*columns, "grp")))


def value_flows(flows: DataFrame) -> DataFrame:
    """(fn, derived, source, transform, condition): values by name `<fn>::<local>#<version>`, each taken from the version of its source that is live
    just before the write; a source never written in the function is its parameter, version 0."""
    w = flows.select("fn", "pos", F.col("derived").alias("local"), F.col("derived_version").alias("version"), F.lit(None).cast("struct<derived:string,version:int,transform:string,condition:string>").alias("use"))
    u = flows.where(F.col("source").isNotNull()).select("fn", "pos", F.col("source").alias("local"), F.lit(None).cast("int").alias("version"), F.struct("derived", F.col("derived_version").alias("version"), "transform", "condition").alias("use"))
    # a use stands before the write of its own statement
    both = w.withColumn("k", F.lit(1)).unionByName(u.withColumn("k", F.lit(0)))
    live = F.last("version", True).over(W.partitionBy("fn", "local").orderBy("pos", "k").rowsBetween(W.unboundedPreceding, -1))
    x = both.withColumn("live", F.coalesce(live, F.lit(0))).where(F.col("use").isNotNull())
    name = lambda local, version: F.concat(F.col("fn"), F.lit("::"), local, F.lit("#"), version)
    return x.select("fn", name(F.col("use.derived"), F.col("use.version")).alias("derived"), name(F.col("local"), F.col("live")).alias("source"), "use.transform", "use.condition").distinct()


def summaries(flows: DataFrame, formals: DataFrame, returns: DataFrame, most: int | None = None) -> DataFrame:
    """(fn, formal): which parameters a function's result depends on, through calls.

    flows: (fn, pos, derived, derived_version, source, transform, condition, callee, args); formals: (fn, idx, local); returns: (fn, local). A call's result
    depends on an argument if the callee's result depends on that parameter: a fixpoint over functions, joined anew until nothing comes.
    Locals are taken without versions, which can only add dependences.
    """
    step = flows.where(F.col("source").isNotNull()).select("fn", F.col("derived").alias("a"), F.col("source").alias("b")).distinct()
    calls = flows.where(F.col("callee").isNotNull()).select("fn", F.col("derived").alias("a"), "callee", F.posexplode("args").alias("idx", "b"))
    back = returns.select("fn", F.col("local").alias("at")).distinct()
    known = None
    n = -1
    rounds = 0
    while most is None or rounds < most:
        rounds += 1
        through = step if known is None else step.unionByName(calls.join(known.select(F.col("fn").alias("callee"), F.col("formal").alias("idx")), ["callee", "idx"]).select("fn", "a", "b")).distinct()
        through = cut(through)
        reach = front = cut(back)
        while True:  # only what is new is followed
            front = cut(front.join(through.withColumnRenamed("a", "at"), ["fn", "at"]).select("fn", F.col("b").alias("at")).distinct().join(reach, ["fn", "at"], "left_anti"))
            if front.isEmpty():
                break
            reach = cut(reach.unionByName(front))
        known = cut(reach.join(formals.select("fn", F.col("idx").alias("formal"), F.col("local").alias("at")), ["fn", "at"]).select("fn", "formal").distinct())
        if known.count() == n:
            return known
        n = known.count()
    return known


def dirty_functions(changed: DataFrame, deps: DataFrame) -> DataFrame:
    """(fn): changed functions and all whose summaries depend on them; a dependence on * is one on any change. deps: (fn, callee)."""
    if changed.isEmpty():
        return changed.select("fn")
    wild = deps.where(F.col("callee") == "*").select("fn")
    reach = front = cut(changed.select("fn").unionByName(wild).distinct())
    while True:
        front = cut(deps.join(front.withColumnRenamed("fn", "callee"), "callee").select("fn").distinct().join(reach, "fn", "left_anti"))
        if front.isEmpty():
            return reach
        reach = cut(reach.unionByName(front))
