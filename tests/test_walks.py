import random
from collections import deque

import pytest

from symloom.graph import CodeGraph
from symloom.model import CONDITIONS, CONFIDENCES, EDGE_DDL, EDGE_KINDS, NODE_DDL
from symloom.operators import ask, walk
from symloom.operators.filters import EdgeFilter


def build(spark, edges, n=None, graph_id=0, kinds=None, **node):
    """edges: (src, dst, kind, condition, confidence, group); nodes get f0, f1, ... as names."""
    n = n or 1 + max([max(e[:2]) for e in edges], default=0)
    rows = []
    for i in range(n):
        d = dict(graph_id=graph_id, node_id=i, kind="function", fqn=f"m::f{i}", file="a.rs", line_start=i, line_end=i, lang="rust", visibility="public", is_abstract=False, own_effects=0, transitive_effects=0, unresolved_calls=0, external_calls=0)
        d |= {k: v[i] for k, v in node.items() if i in v}
        rows.append(d)
    E = []
    for i, e in enumerate(sorted(edges, key=lambda e: (e[0], e[1], EDGE_KINDS.index(e[2])))):
        E.append(dict(graph_id=graph_id, edge_id=i, src=e[0], dst=e[1], kind=e[2], condition=e[3], confidence=e[4], tier=1, rule="test", cut_markers=[], candidate_group=e[5] if len(e) > 5 else None))
    nodes = spark.createDataFrame([tuple(r.get(c) for c in ["graph_id", *_names(NODE_DDL)]) for r in rows], "graph_id int, " + NODE_DDL)
    es = spark.createDataFrame([tuple(r.get(c) for c in ["graph_id", *_names(EDGE_DDL)]) for r in E], "graph_id int, " + EDGE_DDL)
    return CodeGraph.of(nodes, es), E


def _names(ddl):
    from symloom.graph import _names as f

    flat, depth, out = "", 0, []
    for c in ddl:
        depth += {"<": 1, ">": -1}.get(c, 0)
        flat += c if not depth else ""
    return [x.split()[0] for x in flat.split(",")]


def queue_bfs(E, start, depth, forward=True):
    """A queue filled in order of (peer, edge): node -> (depth, path, edges, raised, conf)."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    out, queue, seen = {}, deque([(start, 0, (start,), (), False, 2)]), {start}
    while queue:
        at, d, path, via, raised, conf = queue.popleft()
        if depth is not None and d == depth:
            continue
        for e in sorted((e for e in E if e[a] == at), key=lambda e: (e[b], e["edge_id"])):
            if e[b] in seen:
                continue
            seen.add(e[b])
            r = False if e["kind"] == "spawns" else raised or e["condition"] in ("exception", "panic")
            c = min(conf, CONFIDENCES.index(e["confidence"]))
            row = (e[b], d + 1, path + (e[b],), via + (e["edge_id"],), r, c)
            out[e[b]] = row[1:]
            queue.append(row)
    return out


def randoms(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n), rng.choice(["calls", "spawns", "calls-virtual"]), rng.choice(CONDITIONS), rng.choice(CONFIDENCES)) for _ in range(m)]


@pytest.mark.parametrize("seed", range(4))
def test_bfs_equals_a_queue_on_both_ways(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([5, 9, 25])
    g, E = build(spark, randoms(rng, n, rng.choice([8, 30, 60])), n)
    for forward in (True, False):
        for depth in (None, 2):
            steps = walk.oriented(EdgeFilter().apply(g), forward)
            seeds = spark.createDataFrame([(0, 0), (1, 1)], "root long, node long")
            want = {(r, k): v for r in (0, 1) for k, v in queue_bfs(E, r, depth, forward).items()}
            for _ in (0,):
                got = {(r["root"], r["node"]): (r["depth"], tuple(r["path"]), tuple(r["edges"]), r["raised"], r["conf"]) for r in walk.bfs(steps, seeds, depth).collect()}
                assert got == want, (forward, depth)


@pytest.mark.parametrize("seed", range(3))
def test_within_reached_and_paths(spark, seed):
    rng = random.Random(10 + seed)
    n = 7
    g, E = build(spark, randoms(rng, n, 14), n)
    steps = walk.oriented(EdgeFilter().apply(g))
    seeds = spark.createDataFrame([(i, i) for i in range(n)], "root long, node long")
    level, want = {(i, i) for i in range(n)}, set()
    for k in range(1, 5):
        level = {(r, e["dst"]) for r, at in level for e in E if e["src"] == at}
        if k >= 2:
            want |= level
    for _ in (0,):
        assert {tuple(r) for r in walk.within(steps, seeds, 2, 4).collect()} == want
    one = seeds.where("root = 0")
    full = {0} | set(queue_bfs(E, 0, None))
    for _ in (0,):
        assert {r["node"] for r in walk.reached(steps, one).collect()} == full
        assert {tuple(r) for r in walk.reached(steps, seeds.where("root < 2"), True).collect()} == {(k, x) for k in (0, 1) for x in {k} | set(queue_bfs(E, k, None))}

    def all_paths(trails):
        out = []

        def go(at, nodes, edges):
            for e in E:
                if e["src"] != at or len(edges) == 4 or (e["edge_id"] in edges if trails else e["dst"] in nodes):
                    continue
                ns, es = nodes + [e["dst"]], edges + [e["edge_id"]]
                if e["dst"] not in nodes[1:]:
                    out.append((e["dst"], tuple(ns), tuple(es)))
                go(e["dst"], ns, es)

        go(0, [0], [])
        return sorted(out)

    for trails in (False, True):
        got = sorted((r["node"], tuple(r["path"]), tuple(r["edges"])) for r in walk.paths(steps, one, None, 1, 4, trails).collect())
        assert got == all_paths(trails)


def test_transience_and_spawn(spark):
    g, _ = build(spark, [(0, 1, "calls", "always", "certain"), (1, 2, "calls", "exception", "probable"), (2, 3, "calls", "always", "certain"), (3, 4, "spawns", "always", "certain")])
    got = {r["fqn"]: (r["raised"], r["min_confidence"]) for r in ask.callees(g, "m::f0", None).collect()}
    assert got == {"m::f1": (False, "certain"), "m::f2": (True, "probable"), "m::f3": (True, "probable"), "m::f4": (False, "probable")}


def test_simple_paths_cap_and_reaches(spark):
    rank = lambda r: range(1 + 3 * r, 4 + 3 * r)
    edges = [(0, x, "calls", "always", "certain") for x in rank(0)] + [(x, y, "calls", "always", "certain") for r in range(2) for x in rank(r) for y in rank(r + 1)] + [(x, 10, "calls", "always", "certain") for x in rank(2)]
    g, _ = build(spark, edges)
    assert ask.simple_paths(g, "f0", "f10", None).count() == 27
    some = [tuple(r["path"]) for r in ask.simple_paths(g, "f0", "f10", None, cap=5).collect()]
    assert sorted(some) == sorted(tuple(r["path"]) for r in ask.simple_paths(g, "f0", "f10", None).collect())[:5]
    assert ask.simple_paths(g, "f0", "f10", 3).count() == 0
    assert [r["path"] for r in ask.reaches(g, "f0", "f10").collect()] == [[0, 1, 4, 7, 10]]
    assert [r["depth"] for r in ask.reaches(g, "f4", "f4").collect()] == [0] and ask.reaches(g, "f10", "f0").count() == 0


def test_unused_and_roots(spark):
    g, _ = build(spark, [(0, 1, "calls", "always", "certain"), (2, 3, "calls", "always", "certain"), (4, 4, "calls", "always", "certain")], entrypoint_kind={0: "main"}, kind={3: "type"})
    assert {r["fqn"] for r in ask.unused(g).collect()} == {"m::f2", "m::f3", "m::f4"}
    assert {r["fqn"] for r in ask.unused(g, kinds=("type",)).collect()} == {"m::f3"}
    assert {r["fqn"] for r in ask.unused(g, spark.createDataFrame([(2,)], "nid long")).collect()} == {"m::f0", "m::f1", "m::f4"}


def test_impacted_tests_lift_closures(spark):
    names = {0: "m::t", 1: "m::g", 2: "m::g::{closure@4}", 3: "m::changed", 4: "m::t2"}
    g, _ = build(spark, [(0, 1, "calls", "always", "certain"), (2, 3, "calls", "always", "certain"), (4, 3, "calls", "always", "probable")], fqn=names, entrypoint_kind={0: "test", 4: "test"})
    got = {r["fqn"]: (r["depth"], r["path"], r["confidence"]) for r in ask.impacted_tests(g, spark.createDataFrame([(3,)], "nid long")).collect()}
    assert got == {"m::t": (3, [0, 1, 2, 3], "possible"), "m::t2": (1, [4, 3], "probable")}


def test_filters_and_empty_graph(spark):
    g, _ = build(spark, [(0, 1, "calls", "always", None), (0, 2, "calls", "loop", "certain"), (0, 3, "references", "always", "certain")])
    ids = lambda f: {r["dst"] for r in f.apply(g).collect()}
    assert ids(EdgeFilter()) == {1, 2} and ids(EdgeFilter(confidence="probable")) == {2} and ids(EdgeFilter(kinds=("references",))) == {3}
    assert ids(EdgeFilter(only=("loop",))) == {2} and ids(EdgeFilter(exclude=("loop",))) == {1}
    empty = CodeGraph(g.nodes.limit(0), g.edges.limit(0), g.candidates)
    assert ask.callees(empty, "f0").count() == 0 and ask.unused(empty).count() == 0 and ask.doctor(empty).count() == 0 and ask.rank(empty).count() == 0
