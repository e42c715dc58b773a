"""Answers as text: tables, JSON, SARIF, and graphs as DOT, Mermaid and D2, and as a forest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row


def rows_of(df: DataFrame, limit: int | None = None) -> list[Row]:
    """Rows for showing; all unless a limit is given. What is too much for a terminal is better written as a table (`--out`)."""
    return (df if limit is None else df.limit(limit)).collect()


def table(rows: list[Row]) -> str:
    if not rows:
        return "(no rows)"
    names = rows[0].__fields__
    cells = [names, *[["" if r[n] is None else str(r[n]) for n in names] for r in rows]]
    width = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(c[i].ljust(width[i]) for i in range(len(names))).rstrip() for c in cells)


def as_json(rows: list[Row], contract=None) -> str:
    out: dict = {"rows": [r.asDict(recursive=True) for r in rows]}
    if contract is not None:
        out["approximation"] = contract.approximation
        out["reasons"] = [vars(r) for r in contract.reasons]
    return json.dumps(out, default=str, sort_keys=True)


def sarif(rows: list[Row], rule: str, message: str = "{fqn}") -> str:
    """SARIF 2.1.0: one result per row with fqn, file and line_start."""
    results = []
    for r in rows:
        d = r.asDict(recursive=True)
        results.append({"ruleId": rule, "level": "note", "message": {"text": message.format(**d)}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": d.get("file") or ""}, "region": {"startLine": max(1, d.get("line_start") or 1)}}}]})
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "symloom", "rules": [{"id": rule}]}}, "results": results}]}, sort_keys=True)


def _parts(edges: list[tuple[str, str, str]]) -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    ids: dict[str, str] = {}
    for a, b, _ in edges:
        for x in (a, b):
            ids.setdefault(x, f"n{len(ids)}")
    return ids, list(dict.fromkeys(edges))


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dot(edges: list[tuple[str, str, str]]) -> str:
    """edges: (source name, target name, label)."""
    ids, every = _parts(edges)
    return "\n".join(["digraph {", *[f"  {i} [label={_quoted(n)}];" for n, i in ids.items()], *[f"  {ids[a]} -> {ids[b]} [label={_quoted(k)}];" for a, b, k in every], "}"])


def mermaid(edges: list[tuple[str, str, str]]) -> str:
    ids, every = _parts(edges)
    safe = lambda s: s.replace('"', "#quot;")
    return "\n".join(["graph TD", *[f'  {i}["{safe(n)}"]' for n, i in ids.items()], *[f'  {ids[a]} -->|"{safe(k)}"| {ids[b]}' for a, b, k in every]])


def d2(edges: list[tuple[str, str, str]]) -> str:
    ids, every = _parts(edges)
    return "\n".join([*[f"{i}: {_quoted(n)}" for n, i in ids.items()], *[f"{ids[a]} -> {ids[b]}: {_quoted(k)}" for a, b, k in every]])


def forest(root: str, edges: list[tuple[str, str]], depth: int = 2, budget: int = 10_000, spanning: bool = False) -> str:
    """A tree of names. Full: a node under each of its parents, (cycle) where it is its own ancestor; spanning: each node once, (seen) later."""
    children: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        children.setdefault(a, []).append(b)
    lines, seen = [root], {root}

    def walk(name: str, indent: str, above: tuple[str, ...]) -> None:
        kids = children.get(name, []) if len(above) <= depth else []
        for i, k in enumerate(kids):
            if len(lines) >= budget:
                if lines[-1] != "...":
                    lines.append("...")
                return
            last = i == len(kids) - 1
            mark = " (cycle)" if k in above else " (seen)" if spanning and k in seen else ""
            lines.append(f"{indent}{'└─ ' if last else '├─ '}{k}{mark}")
            seen.add(k)
            if not mark:
                walk(k, indent + ("   " if last else "│  "), (*above, k))

    walk(root, "", (root,))
    return "\n".join(lines)
