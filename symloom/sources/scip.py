"""Reader of SCIP indexes: the wire format of protocol buffers, decoded to rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCCURRENCES = "path string, lang string, symbol string, roles int, line int, col int, end_line int, end_col int"
RELATIONS = "path string, symbol string, target string, is_reference boolean, is_implementation boolean, is_type_definition boolean"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: an int for numbers, bytes for what has a length."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7
            if shift > 63:
                raise ValueError("a number runs over 64 bits")

    try:
        while at < len(data):
            key = number()
            kind = key & 7
            if kind == 0:
                yield key >> 3, number()
            elif kind == 2:
                n = number()
                if at + n > len(data):
                    raise ValueError("a field runs over the end")
                yield key >> 3, data[at : at + n]
                at += n
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
                yield key >> 3, data[at : at + n]
                at += n
            else:
                raise ValueError(f"unknown wire type {kind}")
    except IndexError:
        raise ValueError("the message is cut off") from None


def _numbers(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n = shift = 0
        while True:
            b = value[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        out.append(n)
    return out


def documents(index: bytes) -> Iterator[tuple[str, str, list[tuple], list[tuple]]]:
    """(path, language, occurrences, relations) of each document. A range is (line, col, end_line, end_col), from 0."""
    for number, doc in fields(index):
        if number != 2:
            continue
        path = lang = ""
        found, links = [], []
        for k, v in fields(doc):
            if k == 1:
                path = v.decode()
            elif k == 4:
                lang = v.decode()
            elif k == 2:
                span, symbol, roles = [], "", 0
                for a, b in fields(v):
                    if a == 1:
                        span += _numbers(b)
                    elif a == 2:
                        symbol = b.decode()
                    elif a == 3:
                        roles = b
                if len(span) == 3:
                    span = [span[0], span[1], span[0], span[2]]
                if len(span) == 4:
                    found.append((symbol, roles, *span))
            elif k == 3:
                symbol, rels = "", []
                for a, b in fields(v):
                    if a == 1:
                        symbol = b.decode()
                    elif a == 4:
                        r = dict(fields(b))
                        rels.append((r.get(1, b"").decode(), bool(r.get(2)), bool(r.get(3)), bool(r.get(4))))
                links += [(symbol, *r) for r in rels]
        yield path, lang, found, links


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences and relations of all index files below a path; roles & 1 is a definition. A broken file is an error."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def occurrences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for content in x["content"]:
                for p, lang, found, _ in documents(bytes(content)):
                    yield pd.DataFrame([(p, lang, *o) for o in found], columns=["path", "lang", "symbol", "roles", "line", "col", "end_line", "end_col"]).astype({c: "int32" for c in ("roles", "line", "col", "end_line", "end_col")})

    def relations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for content in x["content"]:
                for p, _, _, links in documents(bytes(content)):
                    yield pd.DataFrame([(p, *r) for r in links], columns=["path", "symbol", "target", "is_reference", "is_implementation", "is_type_definition"])

    return files.mapInPandas(occurrences, OCCURRENCES), files.mapInPandas(relations, RELATIONS)


def relabel(edges: DataFrame, sites: DataFrame, occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """edges with the confidence raised where an index knows the target: certain for one definition, else probable; nothing is lowered.

    sites: (site_id, path, line, col); definitions: (symbol, node) as node ids of the graph.
    """
    at = sites.join(occurrences.where(F.col("roles").bitwiseAND(F.lit(1)) == 0).select("path", "line", "col", "symbol"), ["path", "line", "col"])
    known = at.join(definitions, "symbol").groupBy("site_id").agg(F.collect_set("node").alias("nodes"))
    x = edges.join(known, "site_id", "left")
    hit = F.array_contains("nodes", F.col("dst"))
    sure = hit & (F.size("nodes") == 1)
    better = F.when(sure, "certain").when(hit & (F.coalesce("confidence", F.lit("possible")) == "possible"), "probable").otherwise(F.col("confidence"))
    return x.withColumn("rule", F.when(hit, F.lit("scip")).otherwise(F.col("rule"))).withColumn("tier", F.when(hit, F.lit(2).cast("tinyint")).otherwise(F.col("tier"))).withColumn("confidence", better).drop("nodes")
