"""Symbol patterns: exact names, short names and globs, as predicates on a column of fully qualified names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATOR = "::|/"


def kind_of(text: str) -> str:
    """glob if the text holds * or ?, fqn if it holds :: or /, else short (the last segment of a name)."""
    if not text:
        raise ValueError("a symbol pattern can't be empty")
    return "glob" if re.search(r"[*?]", text) else "fqn" if "::" in text or "/" in text else "short"


def short_name(fqn: Column) -> Column:
    """The last segment of a name; null for null."""
    return F.element_at(F.split(fqn, _SEPARATOR), -1)


def glob_regex(glob: str) -> str:
    """An anchored expression: ** is anything, * anything within a segment, ? one character that is no separator."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(r"[\s\S]*")
            i += 2
        elif glob[i] == "*":
            out.append(r"(?:(?!::)[^/])*")
            i += 1
        elif glob[i] == "?":
            out.append("[^:/]")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return r"\A" + "".join(out) + r"\z"


def matches(text: str, fqn: Column) -> Column:
    """Whether names match the pattern; null for null names."""
    kind = kind_of(text)
    if kind == "glob":
        return fqn.rlike(glob_regex(text))
    if kind == "fqn":
        return fqn == F.lit(text)
    return short_name(fqn) == F.lit(text)
