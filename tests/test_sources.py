import subprocess

import pytest

from symloom.link.linker import link
from symloom.operators import ask, diff
from symloom.sources import git, python_frontend, scip
from symloom.sources.store import Fragments, Store, overlay
from symloom.streaming.incremental import edge_counts, index_stream, watch

FILES = {
    "src/pkg/a.py": "import threading\nfrom .b import helper as h\nfrom . import b\n\nclass Base:\n    LIMIT = 3\n    def go(self, x: int = 1) -> int:\n        return x\n\nclass Kid(Base):\n    @override\n    def go(self, x=1):\n        try:\n            y = h(x)\n        except ValueError:\n            b.other()\n        for i in range(3):\n            self.go(i)\n        return y\n\ndef main():\n    k = Kid()\n    k.go(2)\n    threading.Thread(target=worker).start()\n    eval('1')\n\nasync def worker():\n    await helper2()\n    f = lambda q: q\n\nasync def helper2():\n    with open('x') as fh:\n        pass\n",
    "src/pkg/b.py": "def helper(v):\n    w = v + 1\n    return w\n\ndef other():\n    return 1\n",
    "tests/test_a.py": "from pkg.a import main\n\ndef test_main():\n    main()\n\nif __name__ == '__main__':\n    test_main()\n",
    "notes.txt": "no code\n",
}


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    run("init", "-q")
    for p, t in FILES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "src/pkg/b.py").write_text(FILES["src/pkg/b.py"] + "\n")
    (tmp_path / "src/pkg/a.py").write_text(FILES["src/pkg/a.py"] + "\n")
    run("commit", "-qam", "two")
    return tmp_path


def test_trees(spark, repo):
    tree = {r["path"]: (r["blob_oid"], bytes(r["content"]).decode()) for r in git.read_tree(spark, str(repo), "HEAD~1", 3).collect()}
    assert {p: t for p, (_, t) in tree.items()} == FILES
    work = {r["path"]: r["blob_oid"] for r in git.read_folder(spark, str(repo)).collect()}
    assert work == dict(git.tree_entries(str(repo), "HEAD"))
    d = diff.dirty_files(git.manifest(git.read_tree(spark, str(repo), "HEAD~1")), git.manifest(git.read_folder(spark, str(repo))))
    assert {tuple(r) for r in d.collect()} == {("src/pkg/a.py", "modified"), ("src/pkg/b.py", "modified")}
    rows = git.commit_files(str(repo), "HEAD")
    c = diff.coupling(spark.createDataFrame(rows, "commit string, n_parents int, path string"), min_cochanges=1)
    assert [tuple(r) for r in c.collect()] == [("src/pkg/a.py", "src/pkg/b.py", 1, 1, 1)]
    b = git.blame(str(repo), "HEAD", "src/pkg/b.py")
    assert len(b) == 7 and b[0][2] != b[-1][2] and git.merge_base(str(repo), "HEAD", "HEAD~1") == subprocess.run(["git", "-C", str(repo), "rev-parse", "HEAD~1"], capture_output=True, text=True).stdout.strip()
    ages = diff.edge_age(spark.createDataFrame([(1, "src/pkg/b.py", 1, 7), (2, "src/pkg/b.py", 1, 3)], "eid long, file string, line_start int, line_end int"), spark.createDataFrame(b, "file string, line int, commit string, author string, author_time long"))
    assert {r["eid"] for r in ages.collect()} == {1, 2}
    db = spark.createDataFrame([("/x/src/a.cc",)], "file string")
    assert [r["path"] for r in git.uncovered_units(spark.createDataFrame([("src/a.cc",), ("src/b.cpp",), ("src/c.h",)], "path string"), db).collect()] == ["src/b.cpp"]


def test_python_to_graph_and_store(spark, repo, tmp_path_factory):
    g = link(python_frontend.facts(python_frontend.read(git.read_tree(spark, str(repo)))))
    n = {r["fqn"]: r for r in g.nodes.collect()}
    assert n["pkg::a::Kid::go"]["kind"] == "method" and n["pkg::a::Base::LIMIT"]["kind"] == "field" and n["pkg::a::main"]["entrypoint_kind"] == "main"
    assert n["tests::test_a::test_main"]["entrypoint_kind"] == "test" and n["pkg::a::helper2"]["own_effects"] == 4 and [p["name"] for p in n["pkg::b::helper"]["signature"]["params"]] == ["v"]
    names = {r["nid"]: r["fqn"] for r in n.values()}
    e = {(names[r["src"]], names[r["dst"]], r["kind"], r["condition"], r["rule"]) for r in g.edges.collect()}
    for want in [("pkg::a::Kid::go", "pkg::b::helper", "calls", "always", "import-ref"), ("pkg::a::Kid::go", "pkg::b::other", "calls-virtual", "exception", "import-ref"), ("pkg::a::main", "pkg::a::Kid", "instantiates", "always", "scope-ref"), ("pkg::a::main", "pkg::a::worker", "spawns", "always", "scope-ref"),
                 ("pkg::a::worker", "pkg::a::helper2", "calls-async", "always", "scope-ref"), ("pkg::a::Kid", "pkg::a::Base", "inherits", "always", "supertrait"), ("pkg::a::Kid::go", "pkg::a::Base::go", "overrides", "always", "trait-override"), ("pkg::a::Kid::go", "pkg::a::Kid::go", "calls-virtual", "loop", "name-method")]:
        assert want in e, want
    assert any(x[:2] == ("tests::test_a::__main__", "tests::test_a::test_main") for x in e)
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    plain = lambda df: df.drop("graph_id", "nid", "eid")
    small = lambda df, *c: df.select(*[(df[x] % (1 << 31)).cast("int").alias(x) if x in c else df[x] for x in df.columns])
    for k in (1, 2):
        store.put(k, plain(g.nodes), small(plain(g.edges), "src", "dst", "candidate_group"), g.candidates.selectExpr("cast(grp as int) candidate_group", "cast(dst as int) dst", "rank"))
    assert store.graph_ids() == [1, 2] and store.read().nodes.count() == 2 * len(n) and store.read(2).edges.count() == g.edges.count()
    assert ask.callees(store.read(1), "pkg::a::main").count() == ask.callees(g, "pkg::a::main").count() > 0
    assert store.prune([2]) == [1] and store.graph_ids() == [2]


def test_broken_and_empty_files():
    assert all(not v for v in python_frontend.extract("a.py", "def f(:\n").values())
    assert [s["scope"] for s in python_frontend.extract("a.py", "")["scopes"]] == [0]


def test_incremental_stream(spark, repo, tmp_path):
    inbox, cache = tmp_path / "in", Fragments(spark, str(tmp_path / "cache"), 1)
    src = git.read_tree(spark, str(repo), "HEAD~1")
    src.write.parquet(str(inbox))
    schema = "blob_oid string, path string, content binary"
    seen = []
    go = lambda: index_stream(watch(spark, str(inbox), schema), cache, python_frontend.read, str(tmp_path / "check"), seen.append).awaitTermination()
    go()
    first = cache.known().count()
    assert first and cache.missing(src.where("path like '%.py'")).count() == 0
    src.write.mode("append").parquet(str(inbox))  # the same again
    go()
    assert cache.known().count() == first
    git.read_tree(spark, str(repo), "HEAD").write.mode("append").parquet(str(inbox))
    go()
    assert {r["blob_oid"] for r in cache.known().where("path = 'src/pkg/b.py'").select("blob_oid").distinct().collect()}.__len__() == 2 and seen


def test_stream_counts(spark, tmp_path):
    rows = spark.sql("select 1 graph_id, cast(id % 5 as int) edge_id, 'calls' kind, timestamp'2025-01-01 00:10:00' loaded_at from range(20)")
    rows.write.parquet(str(tmp_path / "e"))
    q = edge_counts(watch(spark, str(tmp_path / "e"), rows.schema.simpleString()[7:-1].replace(":", " "))).writeStream.format("memory").queryName("n_edges").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.table("n_edges").collect()] == [5]


def test_overlay(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 1)], "path string, v int"), spark.createDataFrame([("y", 2)], "path string, v int")
    assert {tuple(r) for r in overlay(a, b).collect()} == {("x", 1), ("y", 2)}


def msg(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def test_scip(spark, tmp_path):
    occ = msg((1, varint(3) + varint(200) + varint(204)), (2, b"sym a"), (3, 1))
    use = msg((1, varint(5) + varint(1) + varint(6) + varint(2)), (2, b"sym a"))
    info = msg((1, b"sym b"), (4, msg((1, b"sym a"), (3, 1))))
    (tmp_path / "x.scip").write_bytes(msg((1, b""), (2, msg((1, b"src/a.rs"), (4, b"rust"), (2, occ), (2, use), (3, info)))))
    o, r = scip.read(spark, str(tmp_path / "x.scip"))
    assert {tuple(x) for x in o.collect()} == {("src/a.rs", "rust", "sym a", 1, 3, 200, 3, 204), ("src/a.rs", "rust", "sym a", 0, 5, 1, 6, 2)}
    assert [tuple(x) for x in r.collect()] == [("src/a.rs", "sym b", "sym a", False, True, False)]
    with pytest.raises(ValueError):
        list(scip.documents(msg((2, b"ab"))[:-1]))
    edges = spark.createDataFrame([(7, 1, "possible", "name-arity", 0), (8, 1, "possible", "x", 0)], "site_id long, dst long, confidence string, rule string, tier int").selectExpr("site_id", "dst", "confidence", "rule", "cast(tier as tinyint) tier")
    sites = spark.createDataFrame([(7, "src/a.rs", 5, 1)], "site_id long, path string, line int, col int")
    got = {x["site_id"]: (x["confidence"], x["rule"], x["tier"]) for x in scip.relabel(edges, sites, o, spark.createDataFrame([("sym a", 1)], "symbol string, node long")).collect()}
    assert got == {7: ("certain", "scip", 2), 8: ("possible", "x", 0)}
