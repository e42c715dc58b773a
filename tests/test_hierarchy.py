import random

import pytest

from symloom.operators import hierarchy, skew

EDGES = "graph_id int, src int, dst int, node int, path string"  # the last two clash with names used inside


def brute(rows):
    parent = {}
    for g, s, d in rows:
        if None not in (g, s, d):
            parent[g, d] = min(s, parent.get((g, d), s))
    nodes = {k for k in parent} | {(g, s) for (g, _), s in parent.items()}
    out = {}
    for g, n in nodes:
        chain, at = [n], n
        while (g, at) in parent and parent[g, at] not in chain:
            at = parent[g, at]
            chain.append(at)
        if (g, at) in parent:  # the chain came back
            ring = chain[chain.index(parent[g, at]) :]
            out[g, n] = (None, None, None, min(ring))
        else:
            out[g, n] = (len(chain) - 1, at, chain[::-1], None)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], EDGES)
    got = {(r["g"], r["node"]): (r["depth"], r["root"], r["path"], r["cycle"]) for r in hierarchy.hierarchy(df).collect()}
    want = brute(rows)
    assert got == want
    found = {(r["g"], r["node"], r["cycle"]) for r in hierarchy.cycle_members(df).collect()}
    assert found == {(*k, v[3]) for k, v in want.items() if v[3] is not None}


def test_random_forests_with_circles(spark):
    rng = random.Random(4)
    rows = []
    for g in range(6):
        n = rng.choice([3, 12, 40])
        for d in range(n):
            if rng.random() < 0.9:
                rows.append((g, rng.randrange(n) if rng.random() < 0.15 else max(0, d - rng.randrange(1, 3)), d))
    rows += rng.sample(rows, 10)
    check(spark, rows)


def test_deep_chain_long_ring_and_self_loop(spark):
    rows = [(1, i, i + 1) for i in range(45)] + [(2, i, (i + 1) % 23) for i in range(23)] + [(2, 5, 100), (2, 100, 101), (3, 7, 7), (3, 7, 8)]
    check(spark, rows)


def test_nulls_duplicates_and_empty(spark):
    check(spark, [(None, 1, 2), (1, None, 2), (1, 1, None), (1, 1, 2), (1, 1, 2), (1, 0, 2)])
    check(spark, [])


def test_descendants(spark):
    df = spark.createDataFrame([(1, 0, 1, 0, ""), (1, 1, 2, 0, "")], EDGES)
    got = {tuple(r) for r in hierarchy.descendants(hierarchy.hierarchy(df)).select("ancestor", "node", "distance").collect()}
    assert got == {(0, 1, 1), (0, 2, 2), (1, 2, 1)}


def test_hot_parent_is_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FLOOR", 20)
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (20, 0.001))
    check(spark, [(1, 0, i) for i in range(1, 200)] + [(1, 3, i) for i in range(200, 240)])


def test_lookup_join_equals_plain_join(spark):
    left = spark.range(300).selectExpr("if(id < 200, 7, id) k", "id v")
    right = spark.range(250).selectExpr("id k", "id * 2 w")
    hot = skew.hot_keys(left, ["k"], floor=50)
    assert hot == [(7,)]
    want = sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)
    assert sorted(map(tuple, skew.lookup_join(left, right, ["k"], "left", hot).collect()), key=str) == want
