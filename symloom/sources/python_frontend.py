"""Facts of Python files, by Python's own parser."""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..link.facts import DEFS, FLOWS, IMPORTS, REFS, RELATIONS, SCOPES, Facts
from ..model import CONDITIONS, EFFECTS

TABLES = {"defs": DEFS, "refs": REFS, "scopes": SCOPES, "imports": IMPORTS, "relations": RELATIONS, "flows": FLOWS}
#: Raised when what is read from a file changes.
VERSION = 2

# Callees and the effect they have, cut hints, and ways to start something.
EFFECT_OF = {
    "blocking": "time.sleep input lock.acquire thread.join queue.get subprocess.run subprocess.call subprocess.check_output".split(),
    "io-file": "open os.remove os.rename os.listdir os.mkdir os.makedirs shutil.copy shutil.rmtree pathlib.Path.write_text pathlib.Path.read_text".split(),
    "io-net": "socket.socket requests.get requests.post urllib.request.urlopen http.client.HTTPConnection".split(),
    "io-proc": "subprocess.run subprocess.Popen subprocess.call subprocess.check_output os.system os.fork os.execv".split(),
    "dynamic-code": "eval exec compile __import__ importlib.import_module".split(),
    "nondeterministic": "random.random random.randint random.choice time.time uuid.uuid4 os.urandom".split(),
}
# Methods that have an effect whatever object they are called on.
EFFECT_OF_METHOD = {
    "io-file": "read_text write_text read_bytes write_bytes mkdir rmdir unlink touch iterdir rglob readlines writelines".split(), "io-net": "connect sendall recv urlopen send_request getresponse".split(),
    "blocking": "acquire sendall recv getresponse".split(), "io-proc": "check_output Popen".split(),
}
SPAWNS = frozenset("threading.Thread multiprocessing.Process asyncio.create_task asyncio.ensure_future loop.create_task executor.submit Thread Process create_task ensure_future".split())
CUTS = {"eval": "dynamic", "exec": "dynamic", "__import__": "dynamic", "import_module": "dynamic", "getattr": "reflective", "setattr": "reflective", "delattr": "reflective", "hasattr": "reflective", "CDLL": "via-ffi", "WinDLL": "via-ffi"}


def module_name(path: str) -> str:
    """The path as a name: folders and stem joined by ::, without a leading src and a final __init__."""
    parts = path.removesuffix(".py").removesuffix(".pyi").split("/")
    if len(parts) > 1 and parts[0] == "src":
        parts = parts[1:]
    if len(parts) > 1 and parts[-1] == "__init__":
        parts = parts[:-1]
    return "::".join(parts)


def _chain(e: ast.expr) -> list[str] | None:
    out: list[str] = []
    while isinstance(e, ast.Attribute):
        out.append(e.attr)
        e = e.value
    return [*([e.id] if isinstance(e, ast.Name) else []), *reversed(out)] if isinstance(e, ast.Name) else None


class Extractor(ast.NodeVisitor):
    """One file: facts by table."""

    def __init__(self, path: str, tree: ast.Module):
        self.path, self.module = path, module_name(path)
        self.out: dict[str, list[dict]] = {k: [] for k in TABLES}
        self.scope, self.scopes = 0, 0
        self.names, self.kinds = [self.module], ["module"]
        self.conditions = ["always"]
        self.owner: dict | None = None
        self.stmt = 0
        self.classes = {n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}
        self.versions: dict[str, int] = {}
        self.out["scopes"].append(dict(path=path, scope=0, parent=None, owner_fqn=None))
        main = [n for n in tree.body if isinstance(n, ast.If) and ast.dump(n.test).find("__main__") >= 0 and ast.dump(n.test).find("__name__") >= 0]
        for n in tree.body:
            if n in main:
                self.function(ast.FunctionDef(name="__main__", args=ast.arguments([], [], None, [], [], None, []), body=n.body, decorator_list=[], lineno=n.lineno, end_lineno=n.end_lineno, col_offset=0), entry="main")
            else:
                self.visit(n)

    @property
    def fqn(self) -> str:
        return "::".join(self.names)

    def define(self, name: str, kind: str, node: ast.AST, **more) -> dict:
        d = dict(path=self.path, lang="python", fqn=f"{self.fqn}::{name}", kind=kind, visibility="private" if name.startswith("_") and not name.startswith("__") else "public", scope=self.scope, line=node.lineno, line_end=getattr(node, "end_lineno", node.lineno), is_abstract=False, own_effects=0) | more
        self.out["defs"].append(d)
        return d

    def enter(self, owner: str | None) -> int:
        before = self.scope
        self.scopes += 1
        self.out["scopes"].append(dict(path=self.path, scope=self.scopes, parent=before, owner_fqn=owner))
        self.scope = self.scopes
        return before

    # definitions
    def function(self, n, entry: str | None = None) -> None:
        in_class = self.kinds[-1] == "type"
        decorators = {(_chain(x.func if isinstance(x, ast.Call) else x) or [""])[-1] for x in n.decorator_list}
        if entry is None:
            if n.name == "main" and self.kinds == ["module"]:
                entry = "async-main" if isinstance(n, ast.AsyncFunctionDef) else "main"
            elif n.name.startswith("test_") or (in_class and self.names[-1].startswith("Test") and n.name.startswith("test")):
                entry = "test"
        a = n.args
        every = [*a.posonlyargs, *a.args, *a.kwonlyargs]
        lacks = len(a.posonlyargs) + len(a.args) - len(a.defaults)
        params = [(p.arg, ast.unparse(p.annotation) if p.annotation else None, i >= lacks, False) for i, p in enumerate(every)] + [(p.arg, None, False, True) for p in (a.vararg, a.kwarg) if p]
        d = self.define(n.name, "method" if in_class else "function", n, is_abstract="abstractmethod" in decorators, entrypoint_kind=entry, arity=len(every) - in_class, signature=(params, ast.unparse(n.returns) if getattr(n, "returns", None) else None, [], "self" if in_class else None))
        if "override" in decorators and in_class:
            self.overrides.append(n.name)
        for x in n.decorator_list:
            self.visit(x)
        saved = (self.owner, self.conditions, self.versions, self.stmt)
        self.owner, self.conditions, self.versions = d, ["always"], {}
        scope = self.enter(d["fqn"])
        self.names.append(n.name)
        self.kinds.append("function")
        for x in n.body:
            self.visit(x)
        self.names.pop()
        self.kinds.pop()
        self.scope = scope
        self.owner, self.conditions, self.versions, self.stmt = saved

    def visit_FunctionDef(self, n: ast.FunctionDef) -> None:
        self.function(n)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, n: ast.Lambda) -> None:
        d = self.define(f"{{closure@{n.lineno}}}", "lambda", n, arity=len(n.args.args))
        saved, self.owner = self.owner, d
        scope = self.enter(d["fqn"])
        self.visit(n.body)
        self.scope, self.owner = scope, saved

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        self.define(n.name, "type", n, entrypoint_kind=None)
        for b in n.bases:
            c = _chain(b)
            if c:
                self.out["relations"].append(dict(path=self.path, lang="python", relation="Inherits", subject=[*self.fqn.split("::"), n.name], object=[c[-1]], line=n.lineno))
        before = getattr(self, "overrides", [])
        self.overrides = []
        scope = self.enter(None)
        self.names.append(n.name)
        self.kinds.append("type")
        for x in n.body:
            self.visit(x)
        self.names.pop()
        self.kinds.pop()
        self.scope = scope
        for m in self.overrides:
            for b in n.bases:
                c = _chain(b)
                if c:
                    self.out["relations"].append(dict(path=self.path, lang="python", relation="Overrides", subject=[*self.fqn.split("::"), n.name, m], object=[c[-1], m], line=n.lineno))
        self.overrides = before

    def targets(self, t: ast.expr) -> Iterator[ast.Name]:
        if isinstance(t, ast.Name):
            yield t
        elif isinstance(t, (ast.Tuple, ast.List)):
            for x in t.elts:
                yield from self.targets(x)
        elif isinstance(t, ast.Starred):
            yield from self.targets(t.value)

    def assign(self, targets: list[ast.expr], value: ast.expr | None, transform: str | None = None) -> None:
        for t in targets:
            for name in self.targets(t):
                kind = "field" if self.kinds[-1] == "type" else "constant" if name.id.isupper() else "variable"
                self.define(name.id, kind, name)
                if self.owner is not None and value is not None:
                    self.flow(name.id, value, transform)

    def flow(self, local: str, value: ast.expr, transform: str | None) -> None:
        self.stmt += 1
        row = dict(path=self.path, fn=self.owner["fqn"], pos=self.stmt, derived=local, condition=self.conditions[-1])
        version = self.versions.get(local, 0) + 1
        self.versions[local] = version
        row["derived_version"] = version
        v = value.value if isinstance(value, ast.Await) else value
        if isinstance(v, ast.Call):
            callee = _chain(v.func)
            args = [(_chain(a) or [""])[0] for a in v.args]
            self.out["flows"].append(row | dict(source=None, transform="other", callee="::".join(callee) if callee else None, args=args))
            return
        how = transform or {ast.Name: "copy", ast.Attribute: "projection", ast.Subscript: "projection", ast.BinOp: "arith", ast.JoinedStr: "concat", ast.IfExp: "branched"}.get(type(v), "composed")
        for name in sorted({x.id for x in ast.walk(v) if isinstance(x, ast.Name)}):
            self.out["flows"].append(row | dict(source=name, transform=how, callee=None, args=None))

    def visit_Assign(self, n: ast.Assign) -> None:
        self.visit(n.value)
        self.assign(n.targets, n.value)

    def visit_AnnAssign(self, n: ast.AnnAssign) -> None:
        if n.value:
            self.visit(n.value)
        self.assign([n.target], n.value)

    def visit_AugAssign(self, n: ast.AugAssign) -> None:
        self.visit(n.value)
        if isinstance(n.target, ast.Name) and self.owner is not None:
            self.flow(n.target.id, ast.BinOp(n.target, n.op, n.value), "arith")

    def visit_NamedExpr(self, n: ast.NamedExpr) -> None:
        self.visit(n.value)
        self.assign([n.target], n.value)

    def visit_Return(self, n: ast.Return) -> None:
        if n.value:
            self.visit(n.value)
            if self.owner is not None:
                self.flow("return", n.value, None)

    # imports
    def visit_Import(self, n: ast.Import) -> None:
        for a in n.names:
            local = a.asname or a.name.split(".")[0]
            self.out["imports"].append(dict(path=self.path, scope=self.scope, local=local, specifier=(a.name if a.asname else a.name.split(".")[0]).replace(".", "::"), exported=None))

    def visit_ImportFrom(self, n: ast.ImportFrom) -> None:
        base = self.module.split("::")
        if n.level:
            keep = len(base) - n.level + (1 if self.path.endswith("__init__.py") else 0)
            base = base[: max(0, keep)]
        else:
            base = []
        spec = "::".join([*base, *(n.module or "").split(".")]).strip(":")
        for a in n.names:
            if a.name != "*":
                self.out["imports"].append(dict(path=self.path, scope=self.scope, local=a.asname or a.name, specifier=spec, exported=a.name))

    # references
    def under(self, condition: str, nodes: list) -> None:
        self.conditions.append(max(self.conditions[-1], condition, key=CONDITIONS.index))
        for x in nodes:
            self.visit(x)
        self.conditions.pop()

    def visit_If(self, n: ast.If) -> None:
        self.visit(n.test)
        self.under("conditional", [*n.body, *n.orelse])

    def visit_IfExp(self, n: ast.IfExp) -> None:
        self.visit(n.test)
        self.under("conditional", [n.body, n.orelse])

    def visit_Match(self, n: ast.Match) -> None:
        self.visit(n.subject)
        for c in n.cases:
            self.under("conditional", c.body)

    def visit_For(self, n: ast.For) -> None:
        self.visit(n.iter)
        self.assign([n.target], n.iter, "projection")
        self.under("loop", n.body)
        self.under("conditional", n.orelse)

    visit_AsyncFor = visit_For

    def visit_While(self, n: ast.While) -> None:
        self.visit(n.test)
        self.under("loop", n.body)
        self.under("conditional", n.orelse)

    def visit_Try(self, n: ast.Try) -> None:
        for x in n.body:
            self.visit(x)
        for h in n.handlers:
            self.under("exception", h.body)
        for x in [*n.orelse, *n.finalbody]:
            self.visit(x)

    visit_TryStar = visit_Try

    def visit_With(self, n: ast.With) -> None:
        for i in n.items:
            c = _chain(i.context_expr)
            if c and "lock" in c[-1].lower():
                self.effect("blocking")
            self.visit(i.context_expr)
            if i.optional_vars is not None:
                self.assign([i.optional_vars], i.context_expr)
        for x in n.body:
            self.visit(x)

    visit_AsyncWith = visit_With

    def effect(self, name: str) -> None:
        if self.owner is not None:
            self.owner["own_effects"] |= 1 << EFFECTS.index(name)

    def visit_Await(self, n: ast.Await) -> None:
        if isinstance(n.value, ast.Call):
            self.call(n.value, awaited=True)
        else:
            self.visit(n.value)

    def visit_Call(self, n: ast.Call) -> None:
        self.call(n)

    def call(self, n: ast.Call, awaited: bool = False) -> None:
        chain = _chain(n.func)
        if chain:
            text = ".".join(chain)
            for e, names in EFFECT_OF.items():
                if text in names:
                    self.effect(e)
            for e, names in EFFECT_OF_METHOD.items():
                if len(chain) > 1 and chain[-1] in names:
                    self.effect(e)
            spawn = text in SPAWNS
            if spawn:
                self.effect("spawns")
            kind = "Spawn" if spawn else "CallAsync" if awaited else "CallVirtualReceiver" if len(chain) > 1 else "Instantiate" if chain[0] in self.classes else "Call"
            target = chain
            if spawn:
                subject = next((_chain(k.value) for k in n.keywords if k.arg == "target"), None) or next((_chain(a.func if isinstance(a, ast.Call) else a) for a in n.args), None)
                target = subject or chain
            cut = [CUTS[chain[-1]]] if chain[-1] in CUTS else []
            self.out["refs"].append(dict(path=self.path, lang="python", name_path=target, scope=self.scope, ref_kind=kind, condition=self.conditions[-1], line=n.lineno, col=n.col_offset, stmt_index=n.lineno, arity=None if any(isinstance(a, ast.Starred) for a in n.args) else len(n.args) + len(n.keywords), cut_markers=cut))
        else:
            self.visit(n.func)
        for a in n.args:
            self.visit(a)
        for k in n.keywords:
            self.visit(k.value)


def extract(path: str, content: str) -> dict[str, list[dict]]:
    """Facts of one file; a file that doesn't parse has none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return {k: [] for k in TABLES}
    return Extractor(path, tree).out


def read(sources: DataFrame) -> DataFrame:
    """(blob_oid, path, kind, fact): facts of Python files as JSON, one row each; a file without facts has a row of kind none.

    sources: (blob_oid, path, content), content text or bytes. Files of other languages and null contents are left out.
    """
    s = sources.where(F.col("path").rlike(r"\.pyi?$") & F.col("content").isNotNull()).select("blob_oid", "path", F.col("content").cast("string").alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for oid, path, content in zip(x["blob_oid"], x["path"], x["content"]):
                facts = [(oid, path, k, json.dumps(f)) for k, fs in extract(path, content).items() for f in fs]
                rows += facts or [(oid, path, "none", "{}")]
            yield pd.DataFrame(rows, columns=["blob_oid", "path", "kind", "fact"])

    return s.mapInPandas(run, "blob_oid string, path string, kind string, fact string")


def facts(rows: DataFrame) -> Facts:
    """The tables of facts behind rows of read()."""
    out = {}
    for k, ddl in TABLES.items():
        schema = rows.sparkSession.createDataFrame([], ddl).schema
        # a signature is written as a list; from_json reads it by position through an array form
        plain = StructType([f for f in schema.fields if f.name != "signature"])
        x = rows.where(F.col("kind") == k).select(F.from_json("fact", plain).alias("f"), "fact")
        cols = [F.col(f"f.{f.name}") for f in plain.fields]
        if k == "defs":
            params = F.from_json(F.get_json_object("fact", "$.signature[0]"), "array<array<string>>")
            param = lambda p: F.struct(p[0].alias("name"), p[1].alias("type_text"), (p[2] == "true").alias("has_default"), (p[3] == "true").alias("variadic"))
            sig = F.when(params.isNotNull(), F.struct(F.transform(params, param).alias("params"), F.get_json_object("fact", "$.signature[1]").alias("return_type_text"), F.array().cast("array<string>").alias("type_params"), F.get_json_object("fact", "$.signature[3]").alias("receiver")))
            cols.append(sig.alias("signature"))
        out[k] = x.select(*cols)
    return Facts(**out)
