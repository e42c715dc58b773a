"""Command line: python -m symloom.cli --store FOLDER COMMAND ... The store is a folder of nodes, edges and candidates tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import render
from .functions.selector import SelectorError
from .graph import CodeGraph
from .operators import ask, contract, diff
from .operators.filters import EdgeFilter
from .plans import cql
from .plans.cql_syntax import CqlError


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symloom")
    p.add_argument("--store", required=True)
    p.add_argument("--graph", type=int, help="one graph of the store; all without it")
    p.add_argument("--format", choices=("human", "json", "sarif", "dot", "mermaid", "d2"), default="human")
    p.add_argument("--confidence", choices=("possible", "probable", "certain"))
    p.add_argument("--exclude", action="append", default=[], metavar="CONDITION")
    p.add_argument("--only", action="append", default=[], metavar="CONDITION")
    p.add_argument("--max-candidates", type=int)
    p.add_argument("--assert-empty", action="store_true")
    p.add_argument("--allow-vacuous", action="store_true")
    p.add_argument("--contract", action="store_true", help="say what the answer may lack or have too much of")
    s = p.add_subparsers(dest="command", required=True)
    for name in ("callers", "callees", "flows-from", "flows-to"):
        c = s.add_parser(name)
        c.add_argument("symbol")
        c.add_argument("--depth", type=int, default=2)
    for name in ("reaches", "paths"):
        c = s.add_parser(name)
        c.add_argument("source")
        c.add_argument("target")
        c.add_argument("--depth", type=int, default=None if name == "reaches" else 6, help="0: unlimited, for paths")
    c = s.add_parser("unused")
    c.add_argument("--kind", action="append", default=[])
    c = s.add_parser("query")
    c.add_argument("text", help="a query, or @file")
    c = s.add_parser("sql")
    c.add_argument("text")
    for name in ("explain", "dump", "footprint"):
        c = s.add_parser(name)
        c.add_argument("symbol")
    c = s.add_parser("search")
    c.add_argument("text")
    c.add_argument("--regex", action="store_true")
    c.add_argument("--kind", action="append", default=[])
    c.add_argument("--limit", type=int, default=50)
    c = s.add_parser("symbols")
    c.add_argument("--by", choices=("total", "inbound", "outbound"), default="total")
    c.add_argument("--limit", type=int, default=50)
    c = s.add_parser("diff")
    c.add_argument("base", type=int)
    c.add_argument("head", type=int)
    c.add_argument("--path-added", nargs=2, metavar=("FROM", "TO"))
    s.add_parser("doctor")
    s.add_parser("interface-map")
    return p


def _answer(g: CodeGraph, a: argparse.Namespace, admit: EdgeFilter):
    """(rows, subject or None, forward)"""
    k = a.command
    if k in ("callers", "callees"):
        return (ask.callers if k == "callers" else ask.callees)(g, a.symbol, a.depth, admit)
    if k in ("flows-from", "flows-to"):
        return (ask.flows_from if k == "flows-from" else ask.flows_to)(g, a.symbol, a.depth)
    if k == "reaches":
        return ask.reaches(g, a.source, a.target, a.depth, admit)
    if k == "paths":
        return ask.simple_paths(g, a.source, a.target, a.depth or None, admit)
    if k == "unused":
        return ask.unused(g, kinds=tuple(a.kind))
    if k == "query":
        text = open(a.text[1:], encoding="utf-8").read() if a.text.startswith("@") else a.text
        return cql.plain(cql.run(g, text))
    if k == "sql":
        g.views()
        return g.nodes.sparkSession.sql(a.text)
    if k == "explain":
        return ask.explain(g, a.symbol)
    if k == "dump":
        return ask.dump(g, a.symbol)
    if k == "footprint":
        return ask.dependency_footprint(g, a.symbol)
    if k == "search":
        if any(x in a.text for x in ("**", "(", "!")) and not a.regex:
            return ask.selected(g, a.text)
        return ask.search(g, a.text, a.regex, tuple(a.kind), a.limit)
    if k == "symbols":
        return ask.rank(g, a.by, a.limit)
    if k == "diff":
        base, head = g.at(a.base), g.at(a.head)
        return diff.new_paths(base, head, *a.path_added) if a.path_added else diff.diff_graphs(base, head)
    return ask.doctor(g) if k == "doctor" else ask.interface_map(g)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return contract.EXIT_OK if e.code == 0 else contract.EXIT_USAGE
    spark = spark or SparkSession.builder.appName("symloom").getOrCreate()
    admit = EdgeFilter(confidence=a.confidence, only=tuple(a.only), exclude=tuple(a.exclude), max_candidates=a.max_candidates)
    try:
        g = CodeGraph.load(spark, a.store)
    except Exception as e:  # noqa: BLE001 - whatever keeps the tables from being read
        print(f"the store can't be read: {str(e).splitlines()[0]}", file=sys.stderr)
        return contract.EXIT_GRAPH
    g = g if a.graph is None else g.at(a.graph)
    try:
        rows = render.rows_of(_answer(g, a, admit))
        told = None
        if a.contract and a.command in ("callers", "callees"):
            told = contract.of_walk(g, ask.resolve_one(g, a.symbol), a.command == "callees", a.depth, admit, not rows)
    except (CqlError, SelectorError, ValueError) as e:
        print(e, file=sys.stderr)
        return contract.EXIT_USAGE
    if a.format == "json":
        print(render.as_json(rows, told))
    elif a.format == "sarif":
        print(render.sarif(rows, a.command))
    elif a.format in ("dot", "mermaid", "d2"):
        paths = [r["path"] for r in rows if "path" in r.__fields__]
        if not paths:
            print(f"{a.format} shows paths; {a.command} gives none", file=sys.stderr)
            return contract.EXIT_USAGE
        ids = sorted({n for p in paths for n in p})
        names = {r["nid"]: r["fqn"] for r in g.nodes.where(F.col("nid").isin(*ids)).select("nid", "fqn").collect()}
        print(getattr(render, a.format)([(names.get(x, str(x)), names.get(y, str(y)), "") for p in paths for x, y in zip(p, p[1:])]))
    else:
        print(render.table(rows))
        if told:
            print(f"{told.approximation}: " + ", ".join(f"{r.code} ({r.count})" for r in told.reasons))
    check = contract.Assertion(a.assert_empty, a.allow_vacuous)
    if not check.assert_empty or rows:
        return check.exit_code(len(rows), 0, True)
    symbol = getattr(a, "symbol", getattr(a, "source", None))
    known = symbol is None or not g.find(symbol).isEmpty()
    return check.exit_code(0, len(render.rows_of(_answer(g, a, EdgeFilter()), 1)) if known else 0, known)


if __name__ == "__main__":
    sys.exit(main())
