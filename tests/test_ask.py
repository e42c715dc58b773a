import itertools
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symloom import cli, render
from symloom.functions import patterns, selector
from symloom.graph import CodeGraph
from symloom.operators import ask, contract, diff
from symloom.operators.filters import EdgeFilter
from test_walks import build

C = ("calls", "always", "certain")
NAMES = ["a", "a::b", "a::bc", "x/y.z", "org::yard::GrainDepot", "org::yard::east::GrainDepot", "org::yard::EmptyDepot", "org::Dep", "a::b::c::d", "a:b", None, ""]


def test_globs(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "fqn string")
    hit = lambda p: [r[0] for r in df.where(patterns.matches(p, F.col("fqn"))).collect()]
    assert hit("a::*") == ["a::b", "a::bc"] and hit("a::**") == ["a::b", "a::bc", "a::b::c::d"] and hit("a::b?") == ["a::bc"] and hit("*") == ["a", "a:b", ""] and hit("GrainDepot") == ["org::yard::GrainDepot", "org::yard::east::GrainDepot"] and hit("x/y.z") == ["x/y.z"] and hit("y.z") == ["x/y.z"]
    with pytest.raises(ValueError):
        patterns.kind_of("")


def seg_match(p, s):
    """One segment of a selector, from its description."""
    parts = re.findall(r"\*+|[^*]+", re.sub(r"!(\*+)", r"\1!", p))
    for i, x in enumerate(parts):
        if x[0] == "*":
            continue
        before, after = i > 0, i < len(parts) - 1
        neg, body = x[0] == "!", x.lstrip("!")
        groups = [g[1:-1].split("|") if g[0] == "(" else [g] for g in re.findall(r"\([^()]*\)|[^()]+", body)]
        any_ = any({(0, 0): s == w, (0, 1): s.startswith(w), (1, 0): s.endswith(w), (1, 1): w in s}[before, after] for w in map("".join, itertools.product(*groups)))
        if any_ == neg:
            return False
    return True


def naive(pattern, segs):
    if not pattern:
        return not segs
    if pattern[0] == "**":
        return any(naive(pattern[1:], segs[i:]) for i in range(len(segs) + 1))
    return bool(segs) and seg_match(pattern[0], segs[0]) and naive(pattern[1:], segs[1:])


def test_selectors_equal_backtracking(spark):
    rng = random.Random(0)
    atoms = ["a", "b", "ab", "*", "a*", "*b", "*a*", "!a", "!a*", "*!b", "!*b", "(a|b)", "(a|ab)b", "!(a|b)", "**", "*a*b*"]
    names = ["::".join(rng.choices(["a", "b", "ab", "ba", "abb"], k=rng.randrange(1, 5))) for _ in range(60)]
    df = spark.createDataFrame([(n,) for n in names], "fqn string")
    for _ in range(40):
        p = rng.choices(atoms, k=rng.randrange(1, 5))
        got = {r[0] for r in df.where(selector.select("::".join(p), F.col("fqn"), F.lit("rust"))).collect()}
        assert got == {n for n in names if naive(p, n.split("::"))}, p


def test_selector_families_and_errors(spark):
    df = spark.createDataFrame([(n, l) for n in NAMES for l in ("java", "rust", "go")], "fqn string, lang string")
    hit = lambda p, agn=False: {tuple(r) for r in df.where(selector.select(p, F.col("fqn"), F.col("lang"), agn)).collect()}
    assert hit("org.yard.*Depot") == {("org::yard::GrainDepot", "java"), ("org::yard::EmptyDepot", "java")}
    assert {r[1] for r in hit("org.yard.!Empty*", True)} == {"java", "rust", "go"} and hit("::a::b") == {("a::b", "rust")}
    for bad in ("", "a?", "a::::b", "(a", "a)", "a b"):
        with pytest.raises(selector.SelectorError):
            selector.parse(bad)
    assert selector.parse("!*x")[0].notes


def test_search_rank_explain_pack(spark):
    g, _ = build(spark, [(0, 1, *C), (0, 1, "calls-virtual", "panic", "possible", 7), (2, 1, *C), (1, 1, *C), (3, 1, "implements", "always", "certain"), (0, 2, "derives-from", "always", "certain")], fqn={0: "m::Alpha", 1: "m::beta"})
    assert [r["fqn"] for r in ask.search(g, "ALPHA").collect()] == ["m::Alpha"] and ask.search(g, "b.ta$", True).count() == 1
    with pytest.raises(ValueError):
        ask.search(g, "")
    top = ask.rank(g, limit=None).collect()
    assert [(r["fqn"], r["inbound"], r["outbound"]) for r in top] == [("m::beta", 4, 1), ("m::Alpha", 0, 3), ("m::f2", 1, 1), ("m::f3", 0, 0)]
    x = {(r["direction"], r["peer"]): r["kind"] for r in ask.explain(g, "beta").collect()}
    assert x == {("caller", 0): "calls", ("caller", 2): "calls"}
    assert [tuple(r)[1:] for r in ask.interface_map(g).collect()] == [("m::f3", "m::beta")]
    assert ask.dump(g, "beta").count() == 5 and ask.export_edges(g, 2, 3).count() == 3 and [tuple(r)[1:] for r in ask.dependency_footprint(g, "Alpha").collect()] == [(1, 1, 0)]
    assert ask.doctor(g).first()["n_calls"] == 4
    g.views("t_")
    assert spark.sql("select count(*) from t_v_call_edges").first()[0] == 6


def test_diff(spark):
    a, _ = build(spark, [(0, 1, *C), (1, 2, *C), (2, 0, "references", "always", "certain")], fqn={0: "x", 1: "y", 2: "z"}, line_start={0: 1, 1: 2, 2: 3})
    b, _ = build(spark, [(0, 1, "calls", "panic", "certain"), (1, 3, *C), (2, 0, "references", "always", "certain")], fqn={0: "x", 1: "y", 2: "z", 3: "w"}, line_start={0: 9, 1: 12, 2: 30, 3: 40})
    d = diff.diff_graphs(a, b)
    got = {(r["record_type"], r["fqn"], r["dst_fqn"], r["change"], r["what"]) for r in d.collect()}
    assert got == {("edge", "x", "y", "changed", "condition"), ("edge", "y", "z", "removed", ""), ("edge", "y", "w", "added", ""), ("node", "w", "", "added", "")}
    assert diff.DiffFilter(condition="panic").apply(d).count() == 1 and diff.DiffFilter(("added",)).apply(d).count() == 2 and diff.DiffFilter(target="w").apply(d).count() == 1
    assert {(r["source"], r["target"]) for r in diff.new_paths(a, b, "*", "w").collect()} == {("x", "w"), ("y", "w")}
    assert [r["dst_fqn"] for r in diff.newer_edges(a, b).collect()] == ["w"]
    m = lambda *x: spark.createDataFrame(list(x), "path string, blob_oid string")
    assert {r["nid"] for r in diff.changed_nodes(a, b, m(("a.rs", "1")), m(("a.rs", "1"))).collect()} == {0, 1, 3}
    assert diff.changed_nodes(a, b, m(("a.rs", "1")), m(("a.rs", "2"))).count() == 4


def test_coupling(spark):
    rows = [(c, 1, p) for c, ps in {"c1": "ab", "c2": "abc", "c3": "bc"}.items() for p in ps] + [("m", 2, "a"), ("m", 2, "b"), ("r", 0, "a"), ("r", 0, "b"), ("c1", 1, "a"), ("c4", 1, None)] + [("big", 1, f"a{i}") for i in range(60)] + [("big", 1, "a"), ("big", 1, "b")]
    df = spark.createDataFrame(rows, "commit string, n_parents int, path string")
    assert [tuple(r) for r in diff.coupling(df).collect()] == [("a", "b", 2, 2, 3), ("b", "c", 2, 3, 2)]
    assert diff.coupling(df, min_cochanges=1).count() == 3 and diff.coupling(df, max_files=0, min_cochanges=1, limit=None).count() == 3 + 62 * 61 // 2 - 1 and diff.coupling(df.limit(0)).count() == 0


def test_contract(spark):
    g, _ = build(spark, [(0, 1, *C), (0, 2, "calls", "always", "possible"), (1, 3, *C), (3, 4, *C)], unresolved_calls={1: 2, 3: 5}, external_calls={1: 1})
    c = contract.of_walk(g, ask.resolve_one(g, "f0"), True, 1, EdgeFilter(confidence="probable"))
    assert {(r.code, r.count) for r in c.reasons} == {("unresolved-external-calls", 2), ("below-confidence-floor", 1), ("depth-limit", 1)} and c.approximation == "under"
    assert contract.of_walk(g, ask.resolve_one(g, "f4"), True, None).approximation == "exact" and contract.of_unused(g).approximation == "over"
    assert contract.Contract((contract.Reason("a", "over", 1), contract.Reason("b", "under", 1))).approximation == "over_under"
    assert [r.code for r in contract.of_paths(g, ask.resolve_one(g, "f4"), None, 5, 5).reasons] == ["truncated-path-cap"]
    assert {(r.code, r.count) for r in contract.of_impacted(g, spark.createDataFrame([(3,)], "nid long")).reasons} == {("impacted-unresolved-calls", 2), ("impacted-external-calls", 1)}
    f = contract.Freshness("a", "b", 0)
    assert f.stale and f.matches_head is False and not contract.Freshness("a").stale
    A = contract.Assertion
    assert [A().exit_code(3, 3, True), A(True).exit_code(1, 1, True), A(True).exit_code(0, 0, True), A(True).exit_code(0, 5, True), A(True).exit_code(0, 0, False), A(True, True).exit_code(0, 0, False)] == [0, 1, 0, 4, 4, 0]


def test_render_and_command_line(spark, tmp_path, capsys):
    g, _ = build(spark, [(0, 1, *C), (1, 2, "calls", "always", "possible"), (2, 0, *C)], fqn={0: "m::a", 1: "m::b", 2: "m::c"})
    for name, df in (("nodes", g.nodes.drop("nid")), ("edges", g.edges.drop("eid").withColumn("candidate_group", F.lit(None).cast("int")).withColumn("src", F.col("src").cast("int")).withColumn("dst", F.col("dst").cast("int"))), ("candidates", spark.createDataFrame([], "graph_id int, candidate_group int, dst int, rank int"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    go = lambda *a: cli.main(["--store", str(tmp_path), *a], spark)
    assert go("callees", "a", "--depth", "1") == 0 and "m::b" in capsys.readouterr().out
    assert go("--format", "json", "query", "MATCH (a)-[:CALLS]->(b) RETURN a.name AS a, b.name AS b") == 0
    assert len(json.loads(capsys.readouterr().out)["rows"]) == 3
    assert go("--format", "dot", "paths", "a", "c", "--depth", "0") == 0 and "n0 -> n1" in capsys.readouterr().out
    assert go("--format", "sarif", "unused") == 0 and json.loads(capsys.readouterr().out)["version"] == "2.1.0"
    assert go("--assert-empty", "callees", "a") == 1 and go("--assert-empty", "callees", "nobody") == 4 and go("--assert-empty", "--confidence", "certain", "callees", "b") == 4 and go("--assert-empty", "--allow-vacuous", "callees", "nobody") == 0
    assert go("query", "MATCH (n) RETURN n") == 2 and go("nonsense") == 2 and cli.main(["--store", str(tmp_path / "no"), "doctor"], spark) == 3
    assert go("--contract", "--confidence", "certain", "callees", "b") == 0 and "below-confidence-floor" in capsys.readouterr().out
    for a in (("symbols",), ("doctor",), ("search", "m::"), ("search", "m::(a|b)"), ("explain", "a"), ("dump", "a"), ("footprint", "a"), ("interface-map",), ("diff", "0", "0"), ("reaches", "a", "c"), ("flows-to", "a"), ("sql", "select count(*) from v_symbols")):
        assert go(*a) == 0
    edges = [("a", "b", "x"), ("b", "a", 'q"')]
    assert "graph TD" in render.mermaid(edges) and "n0 -> n1: \"x\"" in render.d2(edges)
    tree = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")]
    assert render.forest("a", tree, 5).count("(cycle)") == 2 and render.forest("a", tree, 5, spanning=True).count("(seen)") == 1 and render.forest("a", tree, 5, budget=2).endswith("...")
