"""Generated, minified or vendored source files and data saved as code.

A Re-Pair grammar is inferred over each file's tokens (numbers in names as one sign, runs of literals as one token): if the grammar is far smaller than the
sequence, a tool wrote the file. A file whose code is little but runs of literals is a data table, and one whose long literals no grammar shortens
is encoded data. A second grammar, whose rules are known by their hash, is the same wherever a passage stands: a file mostly covered by rules
that several repositories share is copied code. Minified files hold most tokens on very long lines. What a copy says of itself is evidence as well: a
package folder, a banner with the package's version, or a version or copyright line that names a project the path names too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, lookup_join
from ..session import cut
from .repair import infer_rounds, phrases, sizes
from .syntax import plain_language

#: Grammar size over sequence length up to which a file counts as written by a tool, and the least number of tokens to judge.
REUSE, LEAST_TOKENS = 0.3, 50
#: Share of a file's code characters in runs of literals from which it is data.
LITERALS = 0.68
#: Characters from which on a literal is judged alone, and the grammar size over its length from which it is encoded data.
LONG_LITERAL, INCOMPRESSIBLE = 200, 0.6
#: Tokens of a line from which on it is a minified one, and the share of tokens on such lines.
LINE_TOKENS, LINE_SHARE = 100, 0.5
#: Tokens of a rule from which on it tells copied code, and the share of a file that shared rules together must cover, with LEAST_TOKENS at least, as files that
#: only begin with the same lines are no copies.
LONG_RULE, SHARED = 12, 0.5
#: Neighbouring literals that make a run.
RUN = 6
#: Characters of source judged at once: a bound of a task's memory.
BATCH_CHARS = 2_000_000

# Folders that package managers and builds keep third-party code in; the next folder is the package.
PACKAGE_FOLDERS = ("vendor", "third_party", "thirdparty", "3rdparty", "external", "deps", "node_modules", "bower_components", "site-packages", "Godeps", "Pods", "Carthage")
_COMMENT = re.compile(r"^\s*(?://|#(?!include|define|if|endif|pragma|!\[|\[)|/\*|\*|\"\"\"|--)")
#: A banner, as packages put it first: the package's name, perhaps with a file's, and a version of three parts.
_BANNER = re.compile(r"^\W*@?[\w.-]+(?:/[\w.-]+)? v?\d+\.\d+\.\d+(?:[+-][\w.]+)?\b")
#: What a line about a release or an owner holds.
_RELEASE = re.compile(r"\b\d+\.\d+(?:\.\d+)?\b|\bcopyright\b|\blicen[cs]e\b|\(c\)|©", re.I)
_WORD = re.compile(r"[A-Za-z][\w-]{2,}")

_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_REST = r'|(?:0[xX][\da-fA-F_]+|\d[\w.]*)|[A-Za-z_$]\w*|\n|[^\s]'
_DOUBLE, _SINGLE = r'"(?:\\[\s\S]|[^"\\\n])*"?', r"'(?:\\[\s\S]|[^'\\\n])*'?"
_TOKENS = {
    "python": re.compile(r"""#[^\n]*|[rbfuRBFU]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|""" + _DOUBLE + "|" + _SINGLE + ")" + _REST),
    "typescript": re.compile(_C_COMMENT + "|" + _DOUBLE + "|" + _SINGLE + r"|`(?:\\[\s\S]|[^`\\])*`?" + _REST),
    "go": re.compile(_C_COMMENT + "|" + _DOUBLE + r"|`[^`]*`?|'(?:\\.[^'\n]*|[^'\\\n])'" + _REST),
    "rust": re.compile(_C_COMMENT + r'|b?r#*"[\s\S]*?"#*|b?' + _DOUBLE + r"|b?'(?:\\.[^'\n]*|[^'\\\n])'" + _REST),
}
_OTHER = re.compile(_C_COMMENT + r'|"""[\s\S]*?(?:"""|\Z)|' + _DOUBLE + "|" + _SINGLE + _REST)
_COMMENTS, _LIT, _NAME, _SIGN, _LINE = range(5)


def _leading_comment(content: str) -> str:
    """All comment lines before the code, with the whole of block comments and docstrings that begin there."""
    out, end = [], ""
    for line in content.lstrip("﻿").splitlines():
        if not line.strip():
            continue
        if not end and not _COMMENT.match(line):
            break
        out.append(line)
        text = line.lstrip()
        if end:
            end = "" if end in text else end
        elif text.startswith(("/*", '"""')):
            closing = "*/" if text.startswith("/*") else '"""'
            end = "" if closing in text[len(closing) :] else closing
    return "\n".join(out)


def _class(token: str) -> int:
    c = token[0]
    if c == "\n":
        return _LINE
    if token.startswith(("//", "/*")):
        return _COMMENTS
    if c.isdigit() or (c in "\"'`" and len(token) > 1) or (token[-1] in "\"'#" and len(token) > 2):
        return _LIT
    return _NAME if c.isalpha() or c in "_$" else _SIGN


class Features:
    """What a file's tokens say. kinds: generated, minified, data, vendored; claims: lines of the leading comment about a release or an owner, as lists of
    words; rules: (hash, start, length) of the long rules of its phrase grammar over `tokens` tokens."""

    __slots__ = ("kinds", "claims", "rules", "tokens")

    def __init__(self, lang: str | None, content: str):
        self.kinds: set[str] = set()
        self.rules: list[tuple[int, int, int]] = []
        self.tokens = 0
        head = _leading_comment(content).splitlines()
        if any(_BANNER.match(x) for x in head):
            self.kinds.add("vendored")
        self.claims = [sorted({w.lower() for w in _WORD.findall(x)}) for x in head if _RELEASE.search(x)]


def features_of(langs: list[str | None], contents: list[str]) -> list[Features]:
    """Features of many files. Their tokens lie in one array, each told by its file, so that a batch costs few array operations, however short its files."""
    out = [Features(l, c) for l, c in zip(langs, contents)]
    spelled, count = [], np.zeros(len(out), np.int64)
    for i, (l, c) in enumerate(zip(langs, contents)):
        if l is not None:
            tokens = _TOKENS.get(l, _OTHER).findall(c)
            if l == "python":
                tokens = [t for t in tokens if t[0] != "#"]
            spelled += tokens
            count[i] = len(tokens)
    if not spelled:
        return out
    code, names = pd.factorize(np.array(spelled, object))
    file = np.repeat(np.arange(len(out)), count)
    of = np.array([_class(x) for x in names], np.int8)
    size = np.array([len(x) for x in names], np.int64)
    kind = of[code]
    line = np.cumsum((kind == _LINE) | np.concatenate(([False], file[1:] != file[:-1])))  # lines of all files in one count
    real = (kind != _LINE) & (kind != _COMMENTS)
    code, kind, line, file = code[real], kind[real], line[real], file[real]
    if not len(code):
        return out
    files = len(out)
    total = lambda weights: np.bincount(file, weights, files).astype(np.int64)
    per_file = np.bincount(file, minlength=files)

    # runs of literals, with commas and signs between them; a run begins with a literal
    literal = kind == _LIT
    edge = np.concatenate(([True], file[1:] != file[:-1]))
    member = literal | np.isin(names, (",", "-", "+"))[code]
    begin = np.flatnonzero(member & (edge | ~np.concatenate(([False], member[:-1]))))
    end = np.flatnonzero(member & np.concatenate((edge[1:] | ~member[1:], [True]))) + 1
    upto, long_upto = np.concatenate(([0], np.cumsum(literal))), np.concatenate(([0], np.cumsum(literal & (size[code] >= LONG_LITERAL))))
    run = (upto[end] - upto[begin] >= RUN) | (long_upto[end] > long_upto[begin])
    begin, end = begin[run], end[run]
    literals_at = np.flatnonzero(literal)
    begin = literals_at[upto[begin]]  # the first literal of the run
    depth = np.zeros(len(code) + 1, np.int64)
    depth[begin] += 1
    depth[end] -= 1
    in_run = np.cumsum(depth[:-1]) > 0
    starts = np.zeros(len(code), bool)
    starts[begin] = True
    held, keep = in_run & literal, ~in_run | starts

    lengths = size[code]
    held_chars, short_chars = total(lengths * held), total(lengths * (held & (lengths < LONG_LITERAL)))
    full = (per_file > 0) & (held_chars >= LITERALS * total(lengths)) & (held_chars > 0)
    table = full & (total(literal) >= RUN) & (short_chars >= 0.5 * held_chars)
    for i in np.flatnonzero(full & ~table).tolist():
        table[i] = _encoded([names[c] for c in code[(file == i) & held & (lengths >= LONG_LITERAL)]])
    kept_n, held_n = total(keep), total(held)
    dense = total(np.bincount(line)[line] >= LINE_TOKENS)
    minified = (per_file >= LEAST_TOKENS) & ~table & (kept_n > LEAST_TOKENS // 2) & (dense - 2 * held_n >= LINE_SHARE * np.maximum(1, per_file - 2 * held_n))

    kept, owner = code[keep], file[keep]
    signs: dict[str, int] = {"": 0}
    sign_of = np.array([signs.setdefault(re.sub(r"\d+", "#", x) if k == _NAME and not x.isalpha() else "\x00" if k == _LIT else x, len(signs)) for x, k in zip(names, of)], np.int64)
    sign = np.where(starts[keep], 0, sign_of[kept])
    # every symbol of a sequence stands in its grammar at least once, so a file of many different ones needs no grammar to be judged
    distinct = np.bincount(np.unique(owner * len(signs) + sign) // len(signs), minlength=files)
    asked = (kept_n >= LEAST_TOKENS) & (distinct <= REUSE * kept_n)
    generated = np.zeros(files, bool)
    if asked.any():
        mine = asked[owner]
        generated = asked & (sizes(sign[mine], owner[mine], files) <= REUSE * kept_n)

    hashes = pd.util.hash_array(np.asarray(names, object), categorize=False)[kept]
    hashes[starts[keep]] = 1
    first = np.concatenate(([0], np.cumsum(kept_n)[:-1]))
    h, at, n = phrases(hashes, owner, LONG_RULE)
    by = owner[at] if len(at) else at
    for x, flags in (("data", table), ("minified", minified), ("generated", generated)):
        for i in np.flatnonzero(flags).tolist():
            out[i].kinds.add(x)
    for i, rule in zip(by.tolist(), zip(h.tolist(), (at - first[by]).tolist(), n.tolist())):
        out[i].rules.append(rule)
    for i, k in enumerate(kept_n.tolist()):
        out[i].tokens = k
    return out


def _encoded(literals: list[str]) -> bool:
    """Whether no grammar over the characters of long literals makes them much shorter."""
    text = "".join(literals)
    if not text:
        return False
    code, names = pd.factorize(np.array(list(text), object))
    return infer_rounds(code, len(names)).size() >= INCOMPRESSIBLE * len(code)


def _judged(langs: list[str | None], contents: list[str]) -> Iterator[Features]:
    """Features of many files, so many at a time that their contents stay within BATCH_CHARS, or one."""
    a, held = 0, 0
    for i, c in enumerate(contents):
        if i > a and held + len(c) > BATCH_CHARS:
            yield from features_of(langs[a:i], contents[a:i])
            a, held = i, 0
        held += len(c)
    if a < len(contents):
        yield from features_of(langs[a:], contents[a:])


def features(blobs: DataFrame) -> DataFrame:
    """(blob_oid, kinds, tokens, claims, rules array<struct<h, at, n>>) of each distinct content; null contents are left out."""

    @F.pandas_udf("kinds array<string>, tokens int, claims array<array<string>>, rules array<struct<h: long, at: int, n: int>>")
    def judge(lang: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = list(_judged(list(lang), list(content)))
        return pd.DataFrame(
            {
                "kinds": [sorted(x.kinds) for x in rows], "tokens": pd.Series([x.tokens for x in rows], dtype="int32"), "claims": [x.claims for x in rows],
                "rules": [[{"h": h, "at": a, "n": n} for h, a, n in x.rules] for x in rows],
            }
        )

    b = blobs.where(F.col("blob_oid").isNotNull() & F.col("content").isNotNull()).groupBy("blob_oid").agg(F.min(plain_language(F.col("lang"))).alias("lang"), F.min("content").alias("content"))
    return b.select("blob_oid", judge("lang", "content").alias("f")).select("blob_oid", "f.*")


def _package_path(path: Column) -> Column:
    folders = "|".join(re.escape(x) for x in PACKAGE_FOLDERS)
    return path.rlike(rf"(^|/)({folders})/(@[^/]+/)?[^/]+/.*[^/]$")


def _named_by_path(repo: Column, path: Column, claims: Column) -> Column:
    """Whether a line about a release or an owner names a project that the path names too, and not the repository itself. Of the path count the folders and
    the first part of a file name of several."""
    parts = F.transform(F.split(F.lower(path), "/"), lambda x: F.regexp_extract(x, r"^([a-z][\w-]*?)(?:_.*|-\d.*|\..*)?$", 1))
    own = F.lower(repo)
    file = F.element_at(F.split(F.lower(path), "/"), -1)
    stem = F.regexp_extract(file, r"^([^.]*)", 1)
    projects = F.array_except(parts, F.array(stem, F.lit("")))
    return F.exists(claims, lambda line: ~F.array_contains(line, own) & (F.size(F.array_intersect(line, projects)) > 0))


def files(graphs: DataFrame, manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """(repo, file, kinds): files that are not hand-written in some snapshot, and why.

    Rows with a null repo, path or blob are left out; repeated rows count once. A file whose content is lost is judged by its path
    alone, a content without a known language by its leading comment and path. An empty file is no case unless in a package folder.
    """
    repos = graphs.where(F.col("repo").isNotNull()).select("graph_id", "repo").distinct()
    used = manifest.where(F.col("path").isNotNull() & F.col("blob_oid").isNotNull()).select("graph_id", "path", "blob_oid").distinct()
    used = cut(used.join(repos, "graph_id").select("repo", "path", "blob_oid").distinct())
    feats = cut(features(blobs))

    owners = used.groupBy("blob_oid").agg(F.min("repo").alias("one"), F.max("repo").alias("other"))
    # rules travel with 64-bit hashes of the blob's id and the repository's name in their place
    b = F.xxhash64("blob_oid").alias("b")
    rules = feats.where(F.size("rules") > 0).select(b, F.explode("rules").alias("r")).select("b", "r.h", "r.at", "r.n")
    owners = owners.select(b, F.xxhash64("one").alias("one"), F.xxhash64("other").alias("other"))
    shared = cut(rules.select("b", "h").join(owners, "b").groupBy("h").agg(F.min(F.least("one", "other")).alias("one"), F.max(F.greatest("one", "other")).alias("other")).where(F.col("one") != F.col("other")).select("h"))
    covered = lookup_join(rules, shared, ["h"], "inner", hot_keys(rules, ["h"]))
    # the union of the shared rules' places: a place counts from the furthest end before it on
    places = covered.groupBy("b").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("x"))
    union = F.aggregate("x", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), lambda s, p: F.struct(F.greatest(s["upto"], p["end"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), p["end"] - F.greatest(s["upto"], p["at"]))).alias("n")))
    copied = places.select("b", union["n"].alias("n")).join(feats.select(b, "blob_oid", "tokens"), "b").where((F.col("n") >= SHARED * F.col("tokens")) & (F.col("n") >= LEAST_TOKENS)).select("blob_oid", F.lit("vendored").alias("kind"))

    told = feats.select("blob_oid", F.explode("kinds").alias("kind")).unionByName(copied)
    by_content = used.join(told, "blob_oid").select("repo", "path", "kind")
    by_path = used.where(_package_path(F.col("path"))).select("repo", "path", F.lit("vendored").alias("kind"))
    by_claim = used.join(feats.where(F.size("claims") > 0).select("blob_oid", "claims"), "blob_oid").where(_named_by_path(F.col("repo"), F.col("path"), F.col("claims"))).select("repo", "path", F.lit("vendored").alias("kind"))
    return by_content.unionByName(by_path).unionByName(by_claim).groupBy("repo", F.col("path").alias("file")).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
