import pytest

from symloom.llm import grammars, syntax
from symloom.llm.lexing import LANGUAGES, lex

GOOD = {
    "python": ["", "# only a note\n", "x = [1,\n 2]\nif x: y = 1\nelse:\n    y = (a for a in x if a)\n", "async def f(a, *, b=1, **k) -> int:\n    '''doc ======='''\n    return await g(a)[1:2, ::3] if a else lambda q, r=2: q\n",
               "@d.e(1)\nclass A(B, metaclass=C):\n    x: int = 3\n    def f(self): pass\n\ntry:\n    import a.b as c, d\nexcept (E, F) as e:\n    raise X from e\nfinally:\n    with open(f'{x!r}') as h, k: del h\n", "while not a and b or c not in d: break\nfor i, (j, k) in z: print(*i, **j)\nx = {**a, 1: 2}; y = {1, 2}; z = {k: v for k, v in w}\nglobal q\n", "v = a @ b ** -c\nassert v, 'no'\nfrom . import (p, q as r,)\n"],
    "c": ["", "#include <a.h>\n#if A\nint x;\n#endif\nstatic const unsigned T[] = { 0x01, 2u, };\nstruct s { int a; struct s *n; };\nint f(int a, char **b) {\n  for (int i = 0; i < 3; i++) { if (a > b[0]) continue; else return -1; }\n  switch (a) { case 1: break; default: g(a, \"x\" \"y\"); }\n  do { a--; } while (a);\n  return a ? (int)b->c : sizeof(int);\n}\n", "typedef struct { int x; } t;\nenum e { A, B = 2 };\nvoid (*fp)(int);\nint g(void) { t v = { .x = 1 }; goto end; end: return v.x; }\n"],
    "cpp": ["#include <x>\nnamespace a { class B : public C { public: B() : x(1) {} int f() const override; private: int x = 0; }; }\ntemplate <typename T> T m(T a) { return a; }\nint main() { auto f = [&](int a) { return a; }; std::vector<int> v{1, 2}; for (auto &x : v) { f(x); } try { throw 1; } catch (...) { } const char *s = R\"(\n<<<<<<< (\n)\"; return 0; }\n"],
    "go": ["package a\n\nimport (\n\t\"b/c\"\n)\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) F(a, b int) (int, error) {\n\tfor i := 0; i < 3; i++ {\n\t\tif x, ok := m[i]; ok {\n\t\t\tgo f(x)\n\t\t}\n\t}\n\tswitch v := a.(type) {\n\tcase int:\n\t\treturn 1, nil\n\tdefault:\n\t}\n\ts := []int{1, 2}\n\tdefer func() { x++ }()\n\treturn s[0], nil\n}\n"],
    "java": ["package a.b;\nimport java.util.*;\npublic class A<T extends B> extends C implements D {\n private final int[] x = {1, 2};\n @Override public <R> List<R> f(Map<String, List<R>> m, int... a) throws E {\n  for (int i : x) { if (i > 0) continue; }\n  Runnable r = () -> { return; };\n  String s = \"\"\"\n {{ (\n\"\"\";\n  try (X y = z()) { y.g(); } catch (E | F e) { throw e; } finally { }\n  return a == null ? (List<R>) m.get(\"k\") : new ArrayList<>();\n }\n}\n", "interface I { int f(); }\nenum E { A, B(1) { }; int x; }\n"],
    "rust": ["use crate::a::{B, c};\n#[derive(Debug)]\npub struct S<'a, T: Clone> { pub x: &'a T }\nimpl<'a, T: Clone> S<'a, T> {\n pub fn f(&self, n: Vec<Option<i64>>) -> Result<i64, String> {\n  let mut t = 0;\n  for i in 0..10 { if i > 3 && t < 5 { t += i; } else { continue; } }\n  let c = |a: i64| a + 1;\n  match n.len() { 0 => return Err(\"x\".to_string()), 1 | 2 => {} _ => t = c(2), }\n  println!(\"{}\", t);\n  Ok(t as i64)\n }\n}\n/* a /* b } */ c */\nconst T: &[u8] = &[0x01, 2];\n"],
    "typescript": ["import { a, b as c } from \"./x\";\nexport class A<T> extends B implements C {\n size = 0;\n constructor(private readonly x: number, y?: string) { super(); }\n f(base, limit) { const q = `a ${b + `n`} {`; for (let i = 0; i < 3; i++) { g(i); } return this.size }\n}\nexport const T = [1, 2,];\nfunction* g(a: Map<string, number[]>): void { yield a }\nconst h = async ({ p, q = 1 }) => { try { await p } catch { } finally { } }\nif (a) b(); else { c?.d() }\ntype U = { k: string } | null;\n", "!function(a){a.b=c=>c?1:void 0}(this);var x=/[(]/g.test(y)\n"],
}
BAD = {
    "python": ["def f(:\n", "x = [1, 2\ny = 3\n", "if x \n", "for a in b:\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "return = 4\n", "f(1))\n", "x = 'abc\n", "  x = 1\n y = 2\n", "#include <a>\nint f(int a) { return a; }\n", "--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-a\n+b\n", "How to do it: it isn't hard.\n", "x = 09\n", "else:\n    pass\n"],
    "c": ["int f( { }\n", "int f(int a) {\n", "int f(void) { return = 4; }\n", "int f(void) { } }\n", "import os\ndef f(): pass\n", "int a[] = { 1, 2 ;\n", "int x = 1;\n>>>>>>> b\n", "/* never closed\n", "# notes on this\nint x;\n", "#if A\nint x;\n", "int f(void) { if (a) else b(); }\n"],
    "cpp": ["class A { public: int f() { return 1; };\n", "int f() { std::string s = \"x; }\n", "package a\nfunc f() {}\n"],
    "go": ["func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nfunc f() int {\n\treturn 1 }\n}\n", "package a\nx := := 1\n"],
    "java": ["public class A { int f() { return 1 } }\n", "class A { void f( { } }\n", "class A { int if = 3; }\n", "class A {\n"],
    "rust": ["fn f( { }\n", "fn f() { let = 4; }\n", "pub fn f() -> i64 { (1 + 2 }\n", "l\n", "def f(): pass\n"],
    "typescript": ["function f( {\n", "const = 4;\n", "export function f(a) { return a; }}\n", "let x = `abc\n", "def f(a):\n    return a\n"],
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_valid_and_invalid_files(lang):
    for text in GOOD[lang]:
        assert grammars.faults(lang, lex(lang, text)) == [], text
    for text in BAD[lang]:
        assert grammars.faults(lang, lex(lang, text)), text


def test_every_cut_of_a_block_is_caught():
    text = "def f(a):\n    if a:\n        return g(a, [1])\n"
    import ast

    for i in range(len(text)):
        part = text[:i]
        try:
            ast.parse(part)
            ok = True
        except SyntaxError:
            ok = False
        assert (grammars.faults("python", lex("python", part)) == []) == ok, part


SCHEMA = "blob_oid string, lang string, content string, n_bytes long, pos int, tok string"


def test_operator_equals_plain_tests(spark):
    rows, want = [], set()
    for lang in GOOD:
        for i, text in enumerate(GOOD[lang] + BAD[lang]):
            rows.append((f"{lang}{i}", lang, text, 0, 1, "x"))
            if i >= len(GOOD[lang]):
                want.add(f"{lang}{i}")
    rows += rows[:4] + [("n", "python", None, 0, 1, ""), (None, "python", "(", 0, 1, ""), ("o", "cobol", "(", 0, 1, ""), ("s", " PY ", "(", 0, 1, ""), ("two", "c", "int x;", 0, 1, ""), ("two", "python", "int x;", 0, 1, "")]
    got = syntax.invalid(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {r["blob_oid"] for r in got} == want | {"s", "two"}
    assert syntax.invalid(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_file(spark):
    rows = [("long", "c", "int t[] = {" + "1, " * 60_000 + "};\n", 0, 1, ""), ("deep", "python", "x = " + "(" * 60 + "1" + ")" * 60 + "\n", 0, 1, ""), ("broken", "c", "int t[] = {" + "1, " * 60_000 + ";\n", 0, 1, "")]
    assert {r["blob_oid"] for r in syntax.invalid(spark.createDataFrame(rows, SCHEMA)).collect()} == {"broken"}


def test_rates(spark):
    blobs = spark.createDataFrame([("a", "c", "int x;", 0, 1, ""), ("b", "c", "int x", 0, 1, ""), ("n", "c", None, 0, 1, "")], SCHEMA)
    manifest = spark.createDataFrame([(1, "x.c", "a"), (1, "y.c", "b"), (1, "y.c", "b"), (2, "y.c", "b"), (1, "z.c", "n"), (1, None, None)], "graph_id int, path string, blob_oid string")
    graphs = spark.createDataFrame([(1, "r"), (2, "r"), (1, "r"), (3, None)], "graph_id int, repo string")
    assert [tuple(r) for r in syntax.rates(blobs, manifest, graphs).collect()] == [("r", "c", 2, 1, 0.5)]
