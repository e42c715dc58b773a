import random

from hypothesis import given, settings
from hypothesis import strategies as st

from symloom.llm import generated, repair


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_repair_round_trip(seq):
    g = repair.infer(seq, 4)
    assert [t for s in g.final for t in g.expand(s)] == seq
    pairs = [(a, b) for a, b in zip(g.final, g.final[1:]) if a != b]
    assert len(pairs) == len(set(pairs))
    assert all(u >= 1 for u in g.uses) and g.size() <= max(len(seq), 1) + 2


def code(rng, n=6):
    names = [f"{a}_{b}" for a in ("walk", "load", "bind", "emit", "seal") for b in ("row", "edge", "node", "path", "graph", "leaf")]
    out = []
    for _ in range(n):
        out.append(f"def {rng.choice(names)}(base, limit={rng.randrange(9)}):")
        for _ in range(rng.randrange(3, 7)):
            a, b = rng.sample(names, 2)
            out.append(rng.choice([f"    {a} = {b}(base - {rng.randrange(99)}, limit)", f"    if {a} > limit:\n        {b}({a}, 'x')", f"    for step in {a}:\n        {b}.run(step * 3)"]))
        out.append("    return base\n")
    return "\n".join(out)


def table(rng, n):
    return "T = [\n" + "".join("    " + ", ".join(f"0x{rng.randrange(256):02x}" for _ in range(8)) + ",\n" for _ in range(n)) + "]\n"


def kinds(content, lang="python"):
    return generated.features_of([lang], [content])[0].kinds


def test_kinds_of_files():
    rng = random.Random(1)
    accessors = "".join(f"def get_field_{i:04d}(msg):\n    return msg.field({rng.randrange(9999)}, {i})\n" for i in range(30))
    assert kinds(accessors) == {"generated"}
    assert kinds(table(rng, 60)) == {"data"}
    assert kinds(code(rng) + table(rng, 6)) == set()
    assert kinds("# Code generated by x. DO NOT EDIT. says the header we look for\n" + code(rng)) == set()
    mini = ";".join(f"var {a}{b}=function({b},{a}){{return {b}*{rng.randrange(99)}+{a}.{b}}}" for a in "abcdefgh" for b in "xyzwvutsr")
    assert "minified" in kinds(mini, "typescript")
    for banner in ("left-pad 3.0.1 - imported unchanged from upstream", "left-pad 3.0.1", "@scope/left-pad v3.0.1 | (c) its authors", "left-pad/core 3.0.1+abc"):
        assert kinds(f"# {banner}\n" + code(rng)) == {"vendored"}
    assert kinds("# thin wrapper over left-pad 3.0\n" + code(rng)) == set()
    assert kinds("x = 1\n# left-pad 3.0.1 - imported unchanged from upstream\n" + code(rng)) == set()
    assert kinds("") == set() and kinds("words only", None) == set()


def test_files_over_tables(spark):
    rng = random.Random(2)
    own, block = code(rng), code(rng, 12)
    lib = (block * 2).replace("base", "value")
    other = code(rng)
    blobs = [("own", "python", own), ("own2", "python", other), ("tab", "python", table(rng, 50)), ("lib1", "py", lib + "\n# one\n"), ("lib2", "Python", lib + "\n# two\n"), ("lost", "python", None), ("gone", "python", None), ("odd", "cobol", "DISPLAY"), ("empty", "c", ""), (None, "c", "int x;")]
    B = spark.createDataFrame([(*b, "x", 1) for b in blobs + blobs[:2]], "blob_oid string, lang string, content string, repo string, tokens int")
    paths = [(1, "src/own.py", "own"), (1, "src/own.py", "own"), (1, "data/tab.py", "tab"), (2, "src/own.py", "tab"), (1, "a/lib.py", "lib1"), (3, "b/lib.py", "lib2"), (3, "vendor/pkg/x.py", "lost"), (3, "vendors/pkg.py", "own2"), (3, "src/gone.py", "gone"), (3, "third_party_ids.py", "odd"), (3, "e.c", "empty"), (1, None, "own"), (9, "no/graph.py", "tab")]
    M = spark.createDataFrame([(*p, "k") for p in paths], "graph_id int, path string, blob_oid string, kind string")
    G = spark.createDataFrame([(1, "r1"), (2, "r1"), (3, "r2"), (3, "r2"), (4, None)], "graph_id int, repo string")
    got = {(r["repo"], r["file"]): r["kinds"] for r in generated.files(G, M, B).collect()}
    assert got[("r1", "data/tab.py")] == ["data"] and got[("r1", "src/own.py")] == ["data"]
    assert "vendored" in got.pop(("r1", "a/lib.py")) and "vendored" in got.pop(("r2", "b/lib.py"))
    assert got.pop(("r2", "vendor/pkg/x.py")) == ["vendored"]
    assert set(got) == {("r1", "data/tab.py"), ("r1", "src/own.py")}
    assert generated.files(G.limit(0), M, B).collect() == [] and generated.files(G, M, B.limit(0)).count() == 1


def test_copies_and_claims_in_any_wording(spark):
    """One content in two repositories, a passage that makes up most of two files, and lines that name the project the path names."""
    rng = random.Random(5)
    G = spark.createDataFrame([(i, f"repo-{i}") for i in range(6)], "graph_id int, repo string")
    whole, part, head = code(rng), code(rng, 10), "import os\nLIMIT = max(1, os.cpu_count() or 1)\n"
    lines = ["Copyright (c) 2019 the quillbox developers", "part of quillbox 2.4, taken over as it is", "SPDX-License-Identifier: MIT, from quillbox", "quillbox release 1.12: do not change here", "synced with quillbox 0.9.1"]
    blobs, paths = [], []

    def add(graph, path, content):
        blobs.append((f"b{len(blobs)}", "python", content))
        paths.append((graph, path, blobs[-1][0]))

    for graph in (1, 2):
        add(graph, f"lib{graph}/whole.py", whole)
        add(graph, f"lib{graph}/part.py", part + code(rng, 3))
        add(graph, f"lib{graph}/head.py", head + code(rng, 2))
    for i, line in enumerate(lines):
        add(3, f"src/quillbox/m{i}.py", f"# {line}\n" + code(rng))
        add(4, f"src/quillbox_m{i}.py", f"# {line}\n" + code(rng))
        add(5, f"src/other/m{i}.py", f"# {line}\n" + code(rng))
    add(5, "src/repo-5/own.py", "# Copyright (c) the repo-5 authors\n" + code(rng))
    M = spark.createDataFrame(paths, "graph_id int, path string, blob_oid string")
    got = {(r["repo"], r["file"]) for r in generated.files(G, M, spark.createDataFrame(blobs, "blob_oid string, lang string, content string")).collect()}
    want = {(f"repo-{g}", f"lib{g}/{x}.py") for g in (1, 2) for x in ("whole", "part")} | {("repo-3", f"src/quillbox/m{i}.py") for i in range(5)} | {("repo-4", f"src/quillbox_m{i}.py") for i in range(5)}
    assert got == want


def test_encoded_strings_and_long_prose():
    rng = random.Random(7)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000))
    prose = "the walk of the graph follows each edge of the node and then the path of the leaf " * 50
    assert kinds(f'DATA = "{blob}"\n') == {"data"} and "data" not in kinds(f'HELP = "{prose}"\n')


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_rounds_round_trip(seq):
    g = repair.infer_rounds(seq, 4)
    assert [t for s in g.final for t in g.expand(s)] == seq
    pairs = [(a, b) for a, b in zip(g.final, g.final[1:]) if a != b]
    assert len(pairs) == len(set(pairs)) and g.size() <= max(len(seq), 1) + 2 and g.size() <= 1.35 * repair.infer(seq, 4).size() + 3


def test_phrases_are_the_same_wherever_they_stand():
    import numpy as np

    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**62, 300)
    found = []
    for pad in (0, 7, 40):
        tokens = np.concatenate((rng.integers(0, 2**62, pad), passage, rng.integers(0, 2**62, 11)))
        h, at, n = repair.phrases(tokens, np.zeros(len(tokens), int), 12)
        found.append(set(h.tolist()))
        assert all(n >= 12) and all(at + n <= pad + 311)
    shared = found[0] & found[1] & found[2]
    assert len(shared) >= 0.7 * len(found[0])
    z = np.zeros(0, np.int64)
    assert not repair.phrases(z, z, 12)[0].size


def test_data_tables_of_any_content():
    rows = lambda cells: "T = [\n" + "".join("    " + ", ".join(cells[i : i + 8]) + ",\n" for i in range(0, len(cells), 8)) + "]\n"
    sparse = ["0x00"] * 480
    sparse[77] = "0x13"
    assert kinds(rows(sparse)) == {"data"}
    assert kinds(rows([f"0x{i % 256:02x}" for i in range(1024)])) == {"data"}
    assert kinds(rows(["0xff", "0x0f"] * 300)) == {"data"}


def test_notices_far_down_the_leading_comment():
    notice, rng = "left-pad 3.0.1", random.Random(6)
    assert "vendored" in kinds("# words of a licence\n" * 60 + f"# {notice}\n" + code(rng))
    assert "vendored" in kinds(f'"""A module.\n\nPlain words.\n{notice}\n"""\n' + code(rng))
    assert "vendored" in kinds(f"/* A file\n   of words\n   {notice}\n*/\nint x;\n", "c")
    assert kinds(f'"""A module."""\nx = 1\n# {notice}\n' + code(rng)) == set()


def test_batches_equal_single_files():
    rng = random.Random(9)
    accessors = "".join(f"def get_field_{i:04d}(msg):\n    return msg.field({rng.randrange(9999)}, {i})\n" for i in range(30))
    files = [("python", code(rng)), (None, "x"), ("python", ""), ("python", table(rng, 60)), ("python", accessors), ("c", "int x = 1;"), ("python", table(rng, 9)), ("python", "# words alone"), ("go", code(rng, 9)), ("python", accessors)]
    rng.shuffle(files)
    langs, contents = zip(*files)
    for x, l, c in zip(generated.features_of(list(langs), list(contents)), langs, contents):
        one = generated.features_of([l], [c])[0]
        assert (x.kinds, x.claims, sorted(x.rules), x.tokens) == (one.kinds, one.claims, sorted(one.rules), one.tokens)
    assert generated.features_of([], []) == []
