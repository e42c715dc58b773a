"""Facts of files in brace languages, by light reading: definitions, scopes, calls, imports and bases, without a full parser.

What this can't tell is left open rather than guessed: receivers have no types, and macros aren't expanded. Languages: rust, go, java,
typescript, c, cpp.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import plain_lang
from ..model import CONDITIONS

#: Raised when what is read from a file changes.
VERSION = 1
EXTENSIONS = {"rs": "rust", "go": "go", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "mts": "typescript", "cts": "typescript", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp"}
_BLANK = re.compile(r"""//[^\n]*|/\*.*?\*/|R"(?P<d>[^()\s]{0,16})\(.*?\)(?P=d)"|b?r(?P<h>#*)".*?"(?P=h)|\"\"\".*?\"\"\"|"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,8})'""", re.S)
# Words that stand before a bracket without being called.
_NOT_CALLED = frozenset("if for while switch match catch return sizeof function func fn new throw typeof await else do in of and or not case synchronized assert super this void delete yield unsafe move loop where impl let const var static".split())
# Heads of statements that look like definitions with a body.
_HEADS = frozenset("if for while switch match catch synchronized return else do try with".split())
_DEF = {
    "rust": re.compile(r"\b(?:fn\s+(?P<function>\w+)|(?:struct|enum|union|trait)\s+(?P<type>\w+)|impl(?:\s*<[^>{]*>)?\s+(?:(?P<trait>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<impl>\w+)|mod\s+(?P<module>\w+))"),
    "go": re.compile(r"\bfunc\s*(?:\(\s*\w*\s*\*?\s*(?P<recv>\w+)[^)]*\)\s*)?(?P<function>\w+)|\btype\s+(?P<type>\w+)\s+(?:struct|interface)"),
    "java": re.compile(r"\b(?:class|interface|enum|record)\s+(?P<type>\w+)(?:<[^{]*?>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<extends>[\w.]+))?(?:\s+implements\s+(?P<implements>[\w.,\s<>]+?))?(?=\s*\{)|\b(?P<function>\w+)\s*\([^(){};]*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{)"),
    "typescript": re.compile(r"\b(?:class|interface)\s+(?P<type>\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<extends>[\w.]+))?(?:\s+implements\s+(?P<implements>[\w.,\s<>]+?))?(?=\s*\{)|\bfunction\s*\*?\s*(?P<fn>\w+)|(?:(?:^|[;{}\n])\s*(?:(?:public|private|protected|static|async|readonly)\s+)*)(?P<function>\w+)\s*\([^(){};]*\)\s*(?::[^{;=]+)?(?=\{)|\b(?:const|let|var)\s+(?P<arrow>\w+)\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>"),
    "c": re.compile(r"\b(?:struct|union|enum)\s+(?P<type>\w+)\s*(?=\{)|\b(?P<function>\w+)\s*\([^(){};]*\)\s*(?=\{)"),
    "cpp": re.compile(r"\b(?:struct|class|union|enum(?:\s+class)?)\s+(?P<type>\w+)(?:\s+final)?(?:\s*:\s*(?P<bases>[^{;]+))?\s*(?=\{)|\bnamespace\s+(?P<module>[\w:]+)\s*(?=\{)|\b(?P<function>~?\w+(?:::~?\w+)*)\s*\([^(){};]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^{;]*)?(?=\{)"),
}
_IMPORT = {
    "rust": re.compile(r"\buse\s+([^;]+);"), "go": re.compile(r'(?:import|^)\s+(?:\w+\s+)?"([^"]+)"', re.M), "java": re.compile(r"\bimport\s+(?:static\s+)?([\w.]+)\s*;"),
    "typescript": re.compile(r"\bimport\s+(?:type\s+)?\{([^}]*)\}\s*from\s*[\"']([^\"']+)[\"']"), "c": None, "cpp": None,
}
_CONDITION = re.compile(r"\b(if|else|match|switch|case)\b|\b(for|while|loop|do)\b|\b(catch)\b")
_CALL = re.compile(r"(?<![\w.:>])((?:\w+(?:\.|::|->))*\w+)(!?)\s*\(")


def language(path: str) -> str | None:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def module_name(path: str, lang: str) -> str:
    parts = path.rsplit(".", 1)[0].split("/")
    if len(parts) > 1 and parts[0] == "src":
        parts = parts[1:]
    if lang == "go" and len(parts) > 1 or parts[-1] in ("mod", "lib", "index") and len(parts) > 1:
        parts = parts[:-1]
    return "::".join(parts)


def _blanked(text: str) -> str:
    """The text with comments and strings replaced by blanks of equal length and line breaks."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def extract(path: str, content: str, lang: str | None = None) -> dict[str, list[dict]]:
    """Facts of one file by table; none for other languages."""
    out: dict[str, list[dict]] = {k: [] for k in ("defs", "refs", "scopes", "imports", "relations", "flows")}
    lang = lang or language(path)
    if lang not in _DEF:
        return out
    text = _blanked(content)
    lines = [0]
    for m in re.finditer("\n", text):
        lines.append(m.end())
    where = lambda i: (bisect.bisect_right(lines, i), i - lines[bisect.bisect_right(lines, i) - 1])
    module = module_name(path, lang)
    out["scopes"].append(dict(path=path, scope=0, parent=None, owner_fqn=None))
    opens: dict[int, dict] = {}  # position of a brace -> what it opens
    skip: set[int] = set()
    for m in _DEF[lang].finditer(text):
        g = {k: v for k, v in m.groupdict().items() if v}
        name = g.get("function") or g.get("fn") or g.get("arrow")
        if name in _HEADS or (name and re.search(r"(?:\bnew|\belse)\s*$", text[max(0, m.start() - 6) : m.start("function") if g.get("function") else m.start()])):
            continue
        kind = "function" if name else "type" if "type" in g else "module" if "module" in g else "impl"
        at = text.find("{", m.end())
        semi = text.find(";", m.end())
        body = at if at >= 0 and (semi < 0 or at < semi) else -1
        d = dict(name=name or g.get("type") or g.get("module") or g.get("impl"), kind=kind, start=m.start(), recv=g.get("recv"), bases=[])
        if name:
            skip.add(m.start("function") if "function" in g else m.start("fn") if "fn" in g else m.start("arrow"))
            inner = re.search(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", text[m.start(next(k for k in ("function", "fn", "arrow") if k in g)) :])
            args = [a for a in (inner[1].split(",") if inner else []) if a.strip() and not re.match(r"\s*&?\s*(?:mut\s+)?self\b|\s*void\s*$", a)]
            d["arity"] = len(args)
        for k, rel in (("extends", "Inherits"), ("implements", "Implements"), ("trait", "Implements"), ("bases", "Inherits")):
            for b in re.split(r",", g.get(k) or ""):
                b = re.sub(r"<.*|\b(?:public|private|protected|virtual)\b", "", b).strip()
                if b:
                    d["bases"].append((rel, re.split(r"::|\.", b)))
        if body >= 0:
            opens.setdefault(body, d)
        elif kind == "type":
            opens[-m.start() - 1] = d  # a type without a body
    if _IMPORT[lang]:
        for m in _IMPORT[lang].finditer(content if lang in ("go", "typescript") else text):
            if lang == "typescript":
                for x in m[1].split(","):
                    n = re.split(r"\s+as\s+", x.strip())
                    if n[0]:
                        target = "::".join([*module.split("::")[:-1], *[p for p in m[2].split("/") if p not in (".", "..")]])
                        out["imports"].append(dict(path=path, scope=0, local=n[-1], specifier=target, exported=n[0]))
            elif lang == "rust":
                base, _, group = m[1].partition("{")
                for x in (group.rstrip("} ").split(",") if group else [""]):
                    full = (base.strip() + x.strip()).replace("crate::", "")
                    n = re.split(r"\s+as\s+", full)
                    parts = n[0].split("::")
                    if parts[-1] and parts[-1] != "*":
                        out["imports"].append(dict(path=path, scope=0, local=n[-1].split("::")[-1], specifier="::".join(parts[:-1]), exported=parts[-1]))
            else:
                parts = re.split(r"[./]", m[1])
                out["imports"].append(dict(path=path, scope=0, local=parts[-1], specifier="::".join(parts[:-1] if lang == "java" else parts), exported=parts[-1] if lang == "java" else None))
    calls = [(m.start(1), m) for m in _CALL.finditer(text)]
    marks = sorted([(i, "{") for i in (m.start() for m in re.finditer(r"\{", text))] + [(i, "}") for i in (m.start() for m in re.finditer(r"\}", text))] + [(i, m) for i, m in calls], key=lambda x: x[0])
    names, scope, scopes = [module], 0, 0
    stack: list[tuple] = []
    condition, owner = "always", None

    def define(d: dict) -> dict:
        line = where(d["start"])[0]
        in_type = bool(stack) and stack[-1][4] in ("type", "impl")
        base = "::".join(names)
        if d["recv"]:
            base += f"::{d['recv']}"
        kind = ("method" if in_type or d["recv"] or ("::" in d["name"] and lang == "cpp") else "function") if d["kind"] == "function" else d["kind"]
        fqn = f"{base}::{d['name']}"
        row = dict(path=path, lang=lang, fqn=fqn, kind=kind, visibility="public", scope=scope, line=line, line_end=line, is_abstract=False, arity=d.get("arity"), own_effects=0)
        if d["kind"] == "function" and d["name"] == "main":
            row["entrypoint_kind"] = "main"
        if d["kind"] == "function" and (d["name"].startswith(("test_", "Test")) or re.search(r"(?:#\[test\]|@Test)[^{};]*$", text[max(0, d["start"] - 120) : d["start"]])):
            row["entrypoint_kind"] = "test"
        if d["kind"] != "impl":
            out["defs"].append(row)
        for rel, obj in d["bases"]:
            out["relations"].append(dict(path=path, lang=lang, relation=rel, subject=fqn.split("::"), object=obj, line=line))
        return row

    for i, d in sorted(opens.items()):
        if i < 0:
            define(d)
    for i, what in marks:
        if what == "{":
            d = opens.get(i)
            before = (scope, condition, owner, len(names))
            if d:
                row = define(d)
                scopes += 1
                out["scopes"].append(dict(path=path, scope=scopes, parent=scope, owner_fqn=row["fqn"] if d["kind"] == "function" else None))
                stack.append((*before, d["kind"], row))
                scope = scopes
                names.append(row["fqn"].removeprefix("::".join(names) + "::"))
                if d["kind"] == "function":
                    condition, owner = "always", row
            else:
                head = text[max(text.rfind(c, 0, i) for c in "{};") + 1 : i]
                c = _CONDITION.search(head)
                new = condition if not c else max(condition, "conditional" if c[1] else "loop" if c[2] else "exception", key=CONDITIONS.index)
                stack.append((*before, "block", None))
                condition = new
        elif what == "}":
            if stack:
                scope, condition, owner, n, _, row = stack.pop()
                del names[n:]
                if row is not None:
                    row["line_end"] = where(i)[0]
        elif owner is not None and i not in skip:
            chain = re.split(r"\.|::|->", what[1])
            if chain[0] in _NOT_CALLED and len(chain) == 1 or what[2] == "!":
                continue
            line, col = where(i)
            made = bool(re.search(r"\bnew\s+$", text[max(0, i - 5) : i]))
            kind = "Instantiate" if made else "Spawn" if lang == "go" and re.search(r"\bgo\s+$", text[max(0, i - 4) : i]) else "CallAsync" if re.search(r"\bawait\s+$", text[max(0, i - 7) : i]) else "CallVirtualReceiver" if "." in what[1] or "->" in what[1] else "Call"
            out["refs"].append(dict(path=path, lang=lang, name_path=chain, scope=scope, ref_kind=kind, condition=condition, line=line, col=col, stmt_index=line, arity=None, cut_markers=[]))
    return out


def read(sources: DataFrame) -> DataFrame:
    """(blob_oid, path, kind, fact), as of the Python frontend; sources: (blob_oid, path, content[, lang]), others than brace languages are left out.

    Where the extension tells no language, lang does; files of the Python frontend are not read again.
    """
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.lower(F.element_at(F.split("path", r"\."), -1)))
    if "lang" in sources.columns:
        told = plain_lang(F.col("lang"))
        lang = F.coalesce(lang, F.when(told.isin(*_DEF) & ~F.col("path").rlike(r"\.pyi?$"), told))
    s = sources.where(F.col("content").isNotNull()).select("blob_oid", "path", F.col("content").cast("string").alias("content"), lang.alias("lang")).where(F.col("lang").isNotNull())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for oid, path, content, lang in zip(x["blob_oid"], x["path"], x["content"], x["lang"]):
                facts = [(oid, path, k, json.dumps(f)) for k, fs in extract(path, content, lang).items() for f in fs]
                rows += facts or [(oid, path, "none", "{}")]
            yield pd.DataFrame(rows, columns=["blob_oid", "path", "kind", "fact"])

    return s.mapInPandas(run, "blob_oid string, path string, kind string, fact string")
