import pytest

from symloom.sources import light_frontend as lf

FILES = {
    "src/a.rs": ("use crate::b::{c, D as E};\npub struct S { x: i64 }\nimpl Show for S {\n    pub fn go(&self, n: i64) -> i64 {\n        // call(no)\n        for i in 0..n { if i > 1 { helper(\"x(\"); } }\n        self.stop(n)\n    }\n}\n#[test]\nfn checks() { E::new(1); println!(\"a\"); }\n",
                 {("a::S", "type"), ("a::S::go", "method"), ("a::checks", "function")}, {("a::S::go", "helper", "Call", "loop"), ("a::S::go", "self.stop", "CallVirtualReceiver", "always"), ("a::checks", "E.new", "Call", "always")}),
    "pkg/x.go": ("package x\n\nimport (\n\t\"p/q\"\n)\n\ntype T struct {\n\tn int\n}\n\nfunc (t *T) Run(a int) int {\n\tgo work(a)\n\treturn q.F(a)\n}\n\nfunc main() {\n\tif true {\n\t\twork(1)\n\t}\n}\n",
                 {("pkg::T", "type"), ("pkg::T::Run", "method"), ("pkg::main", "function")}, {("pkg::T::Run", "work", "Spawn", "always"), ("pkg::T::Run", "q.F", "CallVirtualReceiver", "always"), ("pkg::main", "work", "Call", "conditional")}),
    "A.java": ("import p.q.R;\npublic class A extends B implements C, D {\n  int f(int a, String b) {\n    try { g(a); } catch (E e) { h(); }\n    return new R(a).k();\n  }\n}\n", {("A::A", "type"), ("A::A::f", "method")}, {("A::A::f", "g", "Call", "always"), ("A::A::f", "h", "Call", "exception"), ("A::A::f", "R", "Instantiate", "always")}),
    "w/b.ts": ("import { a as z } from \"./c\";\nexport class K {\n  size = 0;\n  go(x) { return z(x); }\n}\nexport async function f(y) { while (y) { await g(y); } }\n", {("w::b::K", "type"), ("w::b::K::go", "method"), ("w::b::f", "function")}, {("w::b::K::go", "z", "Call", "always"), ("w::b::f", "g", "CallAsync", "loop")}),
    "m.c": ("#include <a.h>\nstruct s { int a; };\nstatic int f(int a, int b) { return g(a) + sizeof(int); }\n", {("m::s", "type"), ("m::f", "function")}, {("m::f", "g", "Call", "always")}),
    "m.cpp": ("namespace n { class A : public B { public: int f() const { return h(1); } }; }\nint A::g() { return 2; }\n", {("m::n", "module"), ("m::n::A", "type"), ("m::n::A::f", "method"), ("m::A::g", "method")}, {("m::n::A::f", "h", "Call", "always")}),
}


@pytest.mark.parametrize("path", sorted(FILES))
def test_definitions_and_calls(path):
    text, defs, calls = FILES[path]
    x = lf.extract(path, text)
    assert {(d["fqn"], d["kind"]) for d in x["defs"]} == defs
    owner = {s["scope"]: s["owner_fqn"] for s in x["scopes"]}
    assert {(owner[r["scope"]], ".".join(r["name_path"]), r["ref_kind"], r["condition"]) for r in x["refs"]} >= calls


def test_imports_bases_and_other_files():
    x = lf.extract("src/a.rs", FILES["src/a.rs"][0])
    assert {(i["local"], i["specifier"], i["exported"]) for i in x["imports"]} == {("c", "b", "c"), ("E", "b", "D")} and x["relations"][0]["object"] == ["Show"]
    assert {(r["relation"], r["object"][-1]) for r in lf.extract("A.java", FILES["A.java"][0])["relations"]} == {("Inherits", "B"), ("Implements", "C"), ("Implements", "D")}
    assert [d["entrypoint_kind"] for d in x["defs"] if d["fqn"] == "a::checks"] == ["test"]
    assert all(not v for v in lf.extract("a.txt", "f()").values()) and lf.extract("e.c", "")["defs"] == [] and lf.extract("b.c", "int f(int a) { {{{")["defs"]


def test_read(spark):
    from symloom.link.linker import link
    from symloom.sources.python_frontend import facts

    rows = [(str(i), p, t) for i, (p, (t, _, _)) in enumerate(FILES.items())] + [("n", "x.c", None), ("o", "x.py", "f()"), ("e", "y.c", ""), ("k", "k.c", "int a(int x) { return x; }\nint b(int y) { if (y) { return a(y); } return 0; }\n")]
    f = lf.read(spark.createDataFrame(rows, "blob_oid string, path string, content string"))
    g = link(facts(f))
    assert {r["fqn"] for r in g.nodes.collect()} == {d[0] for _, ds, _ in FILES.values() for d in ds} | {"k::a", "k::b"}
    assert [(r["kind"], r["condition"], r["rule"]) for r in g.edges.collect()] == [("calls", "conditional", "scope-ref")]


def test_read_takes_every_file_of_a_brace_language(spark):
    ts = "export function f(y) { return g(y); }\n"
    rows = [(x, f"w/{x}.{x}", ts, None) for x in ("mjs", "cjs", "mts", "cts")] + [("odd", "w/odd.es6", ts, " TS"), ("bare", "tool", ts, "TypeScript"), ("py", "w/p.py", ts, "ts"), ("none", "w/n.txt", ts, None), ("other", "w/o.cob", ts, "cobol")]
    f = lf.read(spark.createDataFrame(rows, "blob_oid string, path string, content string, lang string"))
    assert {(r["blob_oid"], r["kind"]) for r in f.where("kind in ('defs', 'refs')").collect()} == {(x, k) for x in ("mjs", "cjs", "mts", "cts", "odd", "bare") for k in ("defs", "refs")}
