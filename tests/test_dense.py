import random
from collections import Counter

import numpy as np

from symloom.operators import dense, symbol_load

EDGES = "graph_id int, edge_id int, src int, dst int, n int, code int"
NODES = "graph_id int, node_id int, fqn string, side string"


def test_counts_of_skewed_sparse_and_null_codes(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), 5 if rng.random() < 0.5 else rng.randrange(10_000)) for _ in range(5000)] + [(9, 4_000_000_000), (None, 1), (1, None), (1, -3)]
    got = {(r["grp"], r["code"]): r["n"] for r in dense.dense_counts(spark.createDataFrame(rows, "grp long, code long")).collect()}
    assert got == dict(Counter(r for r in rows if None not in r and r[1] >= 0))


def test_kernel_equals_counter_for_codes_too_sparse_for_an_array():
    g = np.array([0, 0, 1, 1], np.int64)
    c = np.array([3, 3, 10**10, 7], np.int64)
    got = Counter()
    for a, b, row in dense._count(g, c):
        for i in np.flatnonzero(row):
            got[int(a), int(b * dense.BLOCK + i)] += int(row[i])
    assert got == Counter(zip(g.tolist(), c.tolist()))


def test_dictionary_is_dense(spark):
    got = dense.dictionary(spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("",)], "k string"), "k", rows_per_block=1).collect()
    assert sorted(r["code"] for r in got) == [0, 1, 2] and {r["k"] for r in got} == {"a", "b", ""}


def test_symbols(spark):
    rng = random.Random(3)
    nodes = [(g, i, f"f{i}" if i < 8 else f"g{g}_{i}", "x") for g in range(3) for i in range(20)]
    edges = [(g, e, rng.randrange(20), 1 if rng.random() < 0.4 else rng.randrange(20), 0, 0) for g in range(3) for e in range(200)]
    name = {n[:2]: n[2] for n in nodes}
    src, dst, peers = Counter(), Counter(), {}
    for g, _, s, d, *_ in edges:
        a, b = name[g, s], name[g, d]
        src[a] += 1
        dst[b] += 1
        peers.setdefault(("src", a), set()).add(b)
        peers.setdefault(("dst", b), set()).add(a)
    E = spark.createDataFrame(edges + edges[:50] + [(None, 1, 1, 1, 0, 0), (1, 999, None, None, 0, 0)], EDGES)
    N = spark.createDataFrame(nodes + nodes[:3] + [(1, 77, None, "x")], NODES)
    got = {(r["side"], r["fqn"]): (r["n_edges"], r["n_peers"]) for r in symbol_load.degrees(E, N).collect()}
    assert got == {("src", k): (v, len(peers["src", k])) for k, v in src.items()} | {("dst", k): (v, len(peers["dst", k])) for k, v in dst.items()}
    total = len(edges) + 1
    want = {(s, k) for s, c in (("src", src), ("dst", dst)) for k, v in c.items() if v >= 0.04 * total}
    assert {tuple(r) for r in symbol_load.heavy(E, N).collect()} == want


def test_empty(spark):
    E, N = spark.createDataFrame([], EDGES), spark.createDataFrame([], NODES)
    assert symbol_load.heavy(E, N).collect() == [] and symbol_load.degrees(E, N).collect() == []


def test_sparse_codes_stay_within_the_bound():
    """A hundred rows in a hundred groups with far codes, and more blocks than one array may hold."""
    import tracemalloc

    from symloom.operators import dense

    for groups, codes in ((np.arange(100), np.full(100, 1_200_000)), (np.zeros(50_000, int), np.arange(50_000) * dense.BLOCK)):
        tracemalloc.start()
        got = {(int(g), b): int(row.sum()) for g, b, row in dense._count(groups, codes)}
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert got == {(int(g), int(c) // dense.BLOCK): 1 for g, c in zip(groups, codes)} and peak < 3 * dense.HELD_BYTES
