import random
from datetime import datetime, timedelta

from symloom.operators import graph_changes

SIG = "struct<params:array<struct<name:string,type_text:string,has_default:boolean,variadic:boolean>>,return_type_text:string,type_params:array<string>,receiver:string>"
NODES = f"graph_id int, node_id int, fqn string, visibility string, is_abstract boolean, entrypoint_kind string, signature {SIG}, repo string, seq int"
EDGES = "graph_id int, edge_id int, src int, dst int, kind string, condition string, confidence string, tier int, mark string"
GRAPHS = "graph_id int, repo string, committed_at timestamp, loaded_at timestamp"


def brute(graphs, nodes, edges):
    series = {}
    for g, repo, at, _ in {x[:3]: x for x in graphs}.values():
        series.setdefault(repo, []).append((at, g))
    name = {(n[0], n[1]): n[2] for n in nodes}
    N, E = {}, {}
    for n in nodes:
        N.setdefault(n[0], {})[n[2]] = n[3:7]
    for e in edges:
        if (e[0], e[2]) in name and (e[0], e[3]) in name:
            E.setdefault(e[0], {})[name[e[0], e[2]], name[e[0], e[3]], e[4]] = e[5:8]
    out = set()
    for snaps in series.values():
        snaps.sort()
        for (_, old), (_, new) in zip(snaps, snaps[1:]):
            for kind, T in (("node", N), ("edge", E)):
                a, b = T.get(old, {}), T.get(new, {})
                for k in a.keys() | b.keys():
                    c = "added" if k not in a else "removed" if k not in b else "changed" if a[k] != b[k] else None
                    if c:
                        out.add((new, kind, *((k, "", "") if kind == "node" else k), c))
    return out


def run(spark, graphs, nodes, edges):
    got = graph_changes.changes(spark.createDataFrame(graphs, GRAPHS), spark.createDataFrame([(*n, "x", 9) for n in nodes], NODES), spark.createDataFrame([(*e, "m") for e in edges], EDGES)).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_random_snapshots(spark):
    rng, t = random.Random(2), datetime(2025, 1, 1)
    graphs, nodes, edges = [], [], []
    g = 0
    for repo in ("a", "b", "c"):
        order = list(range(rng.choice([1, 3, 4])))
        rng.shuffle(order)
        for k in order:
            g += 1
            graphs.append((g, repo, t + timedelta(days=k), t))
            names = rng.sample([f"f{i}" for i in range(12)], 8)
            for i, f in enumerate(names):
                nodes.append((g, i, f, rng.choice(["public", "private"]), rng.choice([True, None]), rng.choice([None, "main"]), rng.choice([None, ([("x", None, False, False)], "int", [], None), ([("x", "int", False, False)], "int", [], None)])))
            for (s, d, kind) in {(rng.randrange(8), rng.randrange(8), rng.choice(["calls", "odd-kind"])) for _ in range(14)}:
                edges.append((g, len(edges), s, d, kind, rng.choice(["always", None]), rng.choice(["certain", None]), rng.choice([0, 1])))
    want = brute(graphs, nodes, edges)
    assert {x[1] for x in want} == {"node", "edge"} and {x[-1] for x in want} == {"added", "removed", "changed"}
    assert run(spark, graphs + graphs[:2], nodes + nodes[:5], edges + edges[:5]) == want


def test_emptied_snapshot_and_nulls(spark):
    t = datetime(2025, 1, 1)
    graphs = [(1, "a", t, t), (2, "a", t + timedelta(days=1), t), (3, None, t, t), (None, "a", t, t)]
    nodes = [(1, 0, "f", "public", False, None, None), (1, 1, None, "public", False, None, None), (None, 0, "f", None, None, None, None)]
    edges = [(1, 0, 0, 0, "calls", "always", None, 0), (1, 1, 0, None, "calls", None, None, 0), (1, 2, 0, 9, "calls", None, None, 0)]
    assert run(spark, graphs, nodes, edges) == {(2, "node", "f", "", "", "removed"), (2, "edge", "f", "f", "calls", "removed")}


def test_empty_tables(spark):
    assert run(spark, [], [], []) == set()


def test_ordinals_stay_when_snapshots_are_added(spark, tmp_path):
    from symloom.operators.snapshots import Ordinals

    rows = lambda *x: spark.createDataFrame(list(x), "series int, fqn string")
    first = {tuple(r[:2]): r[2] for r in Ordinals(spark, ["series", "fqn"], 2, str(tmp_path)).extend(rows(*[(1, f"f{i}") for i in range(20)], (1, "f0"), (None, "f1"))).collect()}
    again = Ordinals(spark, ["series", "fqn"], 7, str(tmp_path))
    second = {tuple(r[:2]): r[2] for r in again.extend(rows((1, "a"), (1, "f3"), (2, "f3"))).collect()}
    assert len(first) == 20 and len(second) == 22 and len(set(second.values())) == 22 and again.blocks == 2
    assert {k: v for k, v in second.items() if k in first} == first


def test_run_bitmaps_and_sets_of_marks():
    import numpy as np

    from symloom.operators import snapshots as s

    rng = random.Random(4)
    for _ in range(200):
        a, b = ({x for x in range(rng.randrange(1, 40)) if rng.random() < 0.6} for _ in range(2))
        ra, rb = (s.runs(np.array(sorted(x), np.int64)) for x in (a, b))
        assert set(s.members(s.and_not(ra, rb)).tolist()) == a - b and set(s.members(s.both_of(ra, rb)).tolist()) == a & b
    # marks 1 and 2 against 2 alone, in either order of rows
    for marks in ([1, 2, 2], [2, 1, 2]):
        i, at, change = s.diff_block(np.zeros(3, int), np.array([0, 0, 1]), np.array([False, False, True]), [np.zeros(3, int)], np.array(marks))
        assert list(change) == [2] and list(at) == [1]
