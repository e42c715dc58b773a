import pytest

from symloom.link import passes
from symloom.link.facts import Facts
from symloom.link.linker import Options, link


def d(fqn, kind="function", path="a.py", scope=0, line=1, **k):
    return dict(path=path, lang=k.pop("lang", "python"), fqn=fqn, kind=kind, scope=scope, line=line, line_end=line, **k)


def r(name, scope, kind="Call", path="a.py", line=9, **k):
    return dict(path=path, lang=k.pop("lang", "python"), name_path=name.split("."), scope=scope, ref_kind=kind, condition=k.pop("condition", "always"), line=line, col=1, stmt_index=line, **k)


def edges(g):
    names = {x["nid"]: x["fqn"] for x in g.nodes.collect()}
    return {(names[e["src"]], names[e["dst"]], e["kind"], e["rule"], e["confidence"], e["candidate_group"] is not None) for e in g.edges.collect()}


def test_ladder(spark):
    f = Facts.empty(
        spark,
        defs=[d("m::f"), d("m::g", line=2), d("m::f::inner", scope=1, line=3), d("n::h", path="b.py"), d("n::K", "type", path="b.py", line=2), d("n::K::run", "method", path="b.py", scope=1, line=3, arity=1), d("o::L::run", "method", path="c.py", arity=2), d("o::far", path="c.py", line=2, arity=1), d("p::far", path="d.py", arity=3), d("q::h2", path="e.go", lang="go")],
        scopes=[dict(path="a.py", scope=0), dict(path="a.py", scope=1, parent=0, owner_fqn="m::f"), dict(path="a.py", scope=2, parent=1), dict(path="b.py", scope=0), dict(path="b.py", scope=1, parent=0, owner_fqn="n::h")],
        imports=[dict(path="a.py", scope=0, local="hh", specifier="n", exported="h"), dict(path="a.py", scope=0, local="n", specifier="n")],
        refs=[r("g", 2), r("inner", 2, line=10), r("hh", 2, line=11), r("n.K", 1, "Instantiate", line=12), r("x.run", 2, "CallVirtualReceiver", line=13), r("far", 1, line=14, arity=1), r("nowhere", 1, line=15), r("h2", 1, line=16), r("cb", 1, "CallCallback", line=17, arity=2), r("g", 0, line=18)],
    )
    g = link(f)
    assert edges(g) == {
        ("m::f", "m::g", "calls", "scope-ref", "certain", False), ("m::f", "m::f::inner", "calls", "scope-ref", "certain", False), ("m::f", "n::h", "calls", "import-ref", "probable", False), ("m::f", "n::K", "instantiates", "import-ref", "probable", False),
        ("m::f", "n::K::run", "calls-virtual", "name-method", "possible", True), ("m::f", "o::L::run", "calls-virtual", "name-method", "possible", True), ("m::f", "o::far", "calls", "name-arity:loc:global", "possible", False), ("m::f", "m::f", "calls-callback", "indirect:2", "possible", False),
    }
    assert {x["fqn"]: x["unresolved_calls"] for x in g.nodes.where("unresolved_calls > 0").collect()} == {"m::f": 2}
    assert [x["fqn"] for x in g.nodes.orderBy("node_id").collect()][:3] == ["m::f", "m::g", "m::f::inner"]
    loose = edges(link(f, Options(arity_filter=False)))
    assert ("m::f", "p::far", "calls", "name-arity:loc:global", "possible", True) in loose
    assert not any(e[3].startswith("name-arity") for e in edges(link(f, Options(name_arity=False))))


def hierarchy_facts(spark, entry=True):
    return Facts.empty(
        spark,
        defs=[d("m::main", entrypoint_kind="main" if entry else None), d("m::T", "type", line=2), d("m::T::go", "method", scope=2, line=3, is_abstract=True), d("m::A", "type", line=4), d("m::A::go", "method", scope=3, line=5), d("m::B", "type", line=6), d("m::B::go", "method", scope=4, line=7), d("z::C::go", "method", path="z.py")],
        scopes=[dict(path="a.py", scope=0), dict(path="a.py", scope=1, parent=0, owner_fqn="m::main")],
        relations=[dict(path="a.py", lang="python", relation="Implements", subject=["A"], object=["m", "T"]), dict(path="a.py", lang="python", relation="Implements", subject=["m", "B"], object=["T"]), dict(path="a.py", lang="python", relation="Overrides", subject=["A", "go"], object=["T", "go"]), dict(path="a.py", lang="python", relation="Inherits", subject=["A"], object=["Nope"])],
        refs=[r("x.go", 1, "CallVirtualReceiver"), r("A", 1, "Instantiate", line=10)],
    )


def test_hierarchy_and_instantiated_types(spark):
    g = link(hierarchy_facts(spark))
    assert ("m::A", "m::T", "implements", "impl-relation", "certain", False) in edges(g) and ("m::A::go", "m::T::go", "overrides", "trait-override", "certain", False) in edges(g)
    assert {e[1] for e in edges(g) if e[3] == "name-method"} == {"m::T::go", "m::A::go", "m::B::go", "z::C::go"}
    c = passes.cha(g)
    assert {e[1:] for e in edges(c) if e[2] == "calls-virtual"} == {(x, "calls-virtual", "cha-trait-set", "possible", True) for x in ("m::A::go", "m::B::go")}
    t = passes.rta(c)
    assert {e[1:] for e in edges(t) if e[2] == "calls-virtual"} == {("m::A::go", "calls-virtual", "rta-pruned", "probable", False)}
    none = passes.rta(passes.cha(link(hierarchy_facts(spark, entry=False))))
    assert len({e for e in edges(none) if e[2] == "calls-virtual"}) == 1


def test_signatures_and_effects(spark):
    sig = lambda n: ([("a", None, False, False)] * n, None, [], None)
    f = Facts.empty(spark, defs=[d("m::f", own_effects=0), d("m::one", line=2, signature=sig(1), own_effects=4), d("m::two", line=3, signature=sig(2), own_effects=1), d("m::top", line=4)], scopes=[dict(path="a.py", scope=0), dict(path="a.py", scope=1, parent=0, owner_fqn="m::f"), dict(path="a.py", scope=2, parent=0, owner_fqn="m::top"), dict(path="a.py", scope=3, parent=0, owner_fqn="m::two")],
                    refs=[r("cb", 1, "CallClosure", arity=1), r("f", 2, line=10), r("top", 3, line=11), r("two", 2, "Spawn", line=12)])
    g = passes.signature_match(link(f))
    assert ("m::f", "m::one", "calls-closure", "sig-compat", "possible", False) in edges(g) and not any(e[3].startswith("indirect") for e in edges(g))
    got = {x["fqn"]: x["transitive_effects"] for x in passes.with_effects(g).nodes.collect()}
    assert got == {"m::one": 4, "m::f": 4, "m::top": 4, "m::two": 5}


def test_value_flows_and_summaries(spark):
    F = [("a.py", "f", 1, "y", 1, "x", "copy", "always", None, None), ("a.py", "f", 2, "y", 2, "y", "arith", "loop", None, None), ("a.py", "f", 3, "z", 1, "y", "copy", "always", None, None), ("a.py", "g", 1, "r", 1, None, None, None, "f", ["p", "q"])]
    from symloom.link.facts import FLOWS

    flows = spark.createDataFrame(F, FLOWS)
    assert {(x["derived"], x["source"]) for x in passes.value_flows(flows).collect()} == {("f::y#1", "f::x#0"), ("f::y#2", "f::y#1"), ("f::z#1", "f::y#2")}
    formals = spark.createDataFrame([("f", 0, "w"), ("f", 1, "x"), ("g", 0, "p"), ("g", 1, "q")], "fn string, idx int, local string")
    returns = spark.createDataFrame([("f", "z"), ("g", "r")], "fn string, local string")
    assert {tuple(x) for x in passes.summaries(flows, formals, returns).collect()} == {("f", 1), ("g", 1)}
    deps = spark.createDataFrame([("g", "f"), ("h", "g"), ("k", "*"), ("o", "p")], "fn string, callee string")
    assert {x["fn"] for x in passes.dirty_functions(spark.createDataFrame([("f",)], "fn string"), deps).collect()} == {"f", "g", "h", "k"}


def test_empty_facts(spark):
    g = link(Facts.empty(spark))
    assert g.nodes.count() == 0 and g.edges.count() == 0


def test_receivers_with_plain_types(spark):
    from symloom.link.facts import FLOWS

    f = hierarchy_facts(spark)
    more = Facts.empty(spark, defs=[d("m::A::both", "method", scope=3, line=8), d("m::D", "type", line=9), d("m::use", line=12)], scopes=[dict(path="a.py", scope=5, parent=0, owner_fqn="m::A::both"), dict(path="a.py", scope=6, parent=0, owner_fqn="m::use")],
                       refs=[r("self.go", 5, "CallVirtualReceiver", line=20), r("k.go", 6, "CallVirtualReceiver", line=21), r("w.go", 6, "CallVirtualReceiver", line=22)], relations=[dict(path="a.py", lang="python", relation="Inherits", subject=["m", "D"], object=["B"])],
                       flows=[dict(path="a.py", fn="m::use", pos=1, derived="k", derived_version=1, callee="D", args=[]), dict(path="a.py", fn="m::use", pos=2, derived="w", derived_version=1, callee="A", args=[]), dict(path="a.py", fn="m::use", pos=3, derived="w", derived_version=2, callee="B", args=[])])
    e = edges(link(f.union(more), Options(receivers=True)))
    assert ("m::A::both", "m::A::go", "calls-virtual", "recv-self", "probable", False) in e and ("m::use", "m::B::go", "calls-virtual", "recv-ctor", "probable", False) in e
    assert {x[3] for x in e if x[0] == "m::use"} == {"recv-ctor", "name-method"}
