"""Node selectors: package patterns in the syntax of a language, compiled to column expressions.

A selector is tried in the syntax of each language family; every family that accepts it contributes. A segment matches by equality,
prefix, suffix or part, `**` stands for any number of segments. Selectors without `**` become a conjunction over the segments of a
name; with `**` a set of states, kept as bits, is folded over the segments. Both stay within Spark's expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Family, separator, characters of a name besides letters, digits and `_`.
FAMILIES = (("rust", "::", ""), ("go", "/", ".-"), ("typescript", ".", "$"), ("java", ".", "$"), ("python", ".", ""))


class SelectorError(ValueError):
    """No family can read the selector."""


@dataclass
class _Option:
    text: str
    negated: bool = False


@dataclass
class _Run:
    """Alternatives between stars; negated as a whole or one by one."""

    options: list[_Option]
    negated: bool = False

    def column(self, before: bool, after: bool, seg: Column) -> Column:
        def hit(t: str) -> Column:
            if before and after:
                return seg.contains(t)
            return seg.endswith(t) if before else seg.startswith(t) if after else seg == F.lit(t)

        any_ = F.lit(False)
        for o in self.options:
            any_ = any_ | (~hit(o.text) if o.negated else hit(o.text))
        return ~any_ if self.negated else any_


@dataclass
class _Segment:
    pieces: list  # "*" or _Run

    def column(self, seg: Column) -> Column:
        out = F.lit(True)
        for i, p in enumerate(self.pieces):
            if p != "*":
                # every run is tested for itself, so a*b* and b*a* with stars around accept the same
                out = out & p.column(i > 0, i < len(self.pieces) - 1, seg)
        return out


@dataclass
class Parsed:
    family: str
    segments: list  # "**" or _Segment
    notes: list[str] = field(default_factory=list)


def _split(text: str, sep: str) -> list[str]:
    parts, depth, at = [""], 0, 0
    while at < len(text):
        if depth == 0 and text.startswith(sep, at):
            parts.append("")
            at += len(sep)
            continue
        depth += {"(": 1, ")": -1}.get(text[at], 0)
        if depth < 0:
            raise SelectorError("unbalanced )")
        parts[-1] += text[at]
        at += 1
    if depth:
        raise SelectorError("unbalanced (")
    return parts


def _segment(text: str, extra: str) -> _Segment:
    name = rf"[A-Za-z0-9_{re.escape(extra)}]+"
    pieces: list = []
    for part in re.split(r"(\*+)", text):
        if not part:
            continue
        if part[0] == "*":
            pieces.append("*")
            continue
        if "?" in part:
            raise SelectorError("? is not part of selectors; use * for any characters")
        negated = part.startswith("!")
        body = part[1:] if negated else part
        atoms = re.findall(rf"\(([^()]*)\)|({name})|(.)", body)
        if not atoms or any(bad for _, _, bad in atoms):
            raise SelectorError(f"can't read {part!r}")
        runs = [[""]]
        mixed: list[_Option] | None = None
        for group, lit, _ in atoms:
            if lit:
                choices = [lit]
            else:
                choices = group.split("|")
                if any(c.startswith("!") for c in choices):
                    if len(atoms) > 1 or negated:
                        raise SelectorError("a negated alternative has to stand alone")
                    mixed = [_Option(c.lstrip("!"), c.startswith("!")) for c in choices]
                    choices = [c.lstrip("!") for c in choices]
                if not all(re.fullmatch(name, c) for c in choices):
                    raise SelectorError(f"can't read ({group})")
            runs.append(choices)
        texts = [""]
        for choices in runs:
            texts = [t + c for t in texts for c in choices]
        pieces.append(_Run(mixed or [_Option(t) for t in texts], negated))
    return _Segment(pieces)


def _parse(family: str, sep: str, extra: str, text: str) -> Parsed:
    parts = _split(text, sep)
    if family == "rust" and len(parts) > 1 and not parts[0]:
        parts = parts[1:]  # a leading :: is the root
    out = Parsed(family, [])
    for p in parts:
        if not p:
            raise SelectorError("empty segment")
        if p == "**":
            if not out.segments or out.segments[-1] != "**":
                out.segments.append("**")
            continue
        moved = re.sub(r"!(\*+)", r"\1!", p)
        if moved != p:
            out.notes.append(f"{p} is read as {moved}")
        out.segments.append(_segment(moved, extra))
    return out


def parse(text: str) -> list[Parsed]:
    """The selector in every family that accepts it; SelectorError if none does."""
    if not text:
        raise SelectorError("empty selector")
    good, bad = [], []
    for family, sep, extra in FAMILIES:
        try:
            good.append(_parse(family, sep, extra, text))
        except SelectorError as e:
            bad.append(str(e))
    if not good:
        raise SelectorError(f"{text!r}: {bad[0]}")
    return good


def _fits(p: Parsed, segs: Column) -> Column:
    if "**" not in p.segments:
        out = F.size(segs) == len(p.segments)
        for i, s in enumerate(p.segments):
            out = out & s.column(F.get(segs, F.lit(i)))
        return out
    globstars = sum(1 << i for i, s in enumerate(p.segments) if s == "**")

    def closed(bits: Column) -> Column:
        return bits.bitwiseOR(F.shiftleft(bits.bitwiseAND(F.lit(globstars)), 1))

    def step(bits: Column, seg: Column) -> Column:
        new = F.lit(0)
        for i, s in enumerate(p.segments):
            here = bits.bitwiseAND(F.lit(1 << i)) != 0
            new = new.bitwiseOR(F.when(here if s == "**" else here & s.column(seg), F.lit(1 << i if s == "**" else 2 << i)).otherwise(F.lit(0)))
        return closed(new)

    final = F.aggregate(segs, closed(F.lit(1)), step)
    return final.bitwiseAND(F.lit(1 << len(p.segments))) != 0


def select(text: str, fqn: Column, lang: Column, agnostic: bool = False) -> Column:
    """Whether a node matches: in a family of its own language or, if agnostic, in any. Null names match nothing."""
    segs = F.split(fqn, "::")
    out = F.lit(False)
    for p in parse(text):
        hit = _fits(p, segs)
        out = out | (hit if agnostic else hit & (lang == F.lit(p.family)))
    return F.coalesce(out, F.lit(False))


def cross_language(text: str, fqn: Column, lang: Column) -> Column:
    """Whether a node matches only because languages are ignored."""
    return select(text, fqn, lang, True) & ~select(text, fqn, lang, False)
