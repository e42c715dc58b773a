import pytest
from pyspark.sql import functions as F

from symloom.link.facts import Facts
from symloom.operators import ask
from symloom.sources.store import Fragments, Store, function_hashes, recomputed
from test_walks import build

C = ("calls", "always", "certain")


def test_put_replaces_all_tables_and_pointers_tell_freshness(spark, tmp_path):
    g, _ = build(spark, [(0, 1, *C), (1, 2, *C)])
    nodes = g.nodes.drop("nid", "graph_id")
    edges = g.edges.drop("eid", "graph_id").select(*[F.col(c).cast("int").alias(c) if c in ("src", "dst", "candidate_group") else F.col(c) for c in g.edges.columns if c not in ("eid", "graph_id")])
    cands = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (0, 2, 1)], "candidate_group int, dst int, rank int")
    store = Store(spark, str(tmp_path / "s"))
    store.put(3, nodes.unionByName(nodes), edges.unionByName(edges), cands)
    held = store.read(3)
    assert held.unique and held.nodes.count() == 3 and held.edges.count() == 2 and held.candidates.count() == 2
    store.put(3, nodes, edges, cands.limit(0))
    assert store.read(3).candidates.count() == 0 and store.read(3).edges.count() == 2
    assert store.head("r") is None
    store.point("r", "tree-a", 3)
    store.point("r", "tree-b", 4)
    assert store.head("r") == (4, True) and store.head("r", "tree-b") == (4, True) and store.head("r", "tree-a") == (4, False) and store.head("other") is None


def test_fragments_are_pruned_and_functions_reused(spark, tmp_path):
    cache = Fragments(spark, str(tmp_path / "f"), 1)
    facts = spark.createDataFrame([("b1", "a.py", 1), ("b2", "b.py", 2), ("b3", "b.py", 3)], "blob_oid string, path string, x int")
    cache.prune(facts)  # nothing there yet
    cache.add(facts)
    cache.prune(spark.createDataFrame([("a.py", "b1"), ("b.py", "b3"), ("b.py", "b1")], "path string, blob_oid string"))
    assert {(r["path"], r["blob_oid"]) for r in cache.known().collect()} == {("a.py", "b1"), ("b.py", "b3")}

    def version(line, arity):
        return function_hashes(Facts.empty(spark, defs=[dict(path="a.py", fqn="m::f", kind="function", line=line), dict(path="a.py", fqn="m::g", kind="function", line=9)], scopes=[dict(path="a.py", scope=1, parent=0, owner_fqn="m::f"), dict(path="a.py", scope=2, parent=0, owner_fqn="m::g")], refs=[dict(path="a.py", name_path=["x", "y"], scope=1, ref_kind="Call", line=line, arity=1), dict(path="a.py", name_path=["z"], scope=2, ref_kind="Call", line=line, arity=arity)]))

    state = {r["fn"]: r["state"] for r in recomputed(version(1, 1), version(5, 2)).collect()}
    assert state == {"m::f": "reused", "m::g": "recomputed"}


def test_anchors_and_packs(spark):
    g, _ = build(spark, [(0, 1, *C), (2, 1, "implements", "always", "certain")], fqn={0: "m::one", 1: "m::two", 2: "m::two"})
    assert [tuple(r) for r in ask.anchor(g, "m::one").collect()] == [(0, 0)] and [tuple(r) for r in ask.anchor(g, "two").collect()] == [(1, 1)] and ask.anchor(g, "m::*").count() == 1
    with pytest.raises(ask.Ambiguous):
        ask.anchor(g, "m::two")
    with pytest.raises(ask.NotFound):
        ask.anchor(g, "m::three")
    p = ask.pack(g, "m::one")
    assert len(p["card_registry"]) == 10 and p["cards"]["dependency-footprint"]["rows"][0]["total"] == 1 and len(p["cards"]["interface-map"]["rows"]) == 1 and p["graphs"][0]["n_nodes"] == 3
    assert ask.pack(g, "nobody")["cards"]["dependency-footprint"] == {"symbol": "nobody", "resolved": False, "rows": []}
