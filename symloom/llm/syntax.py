"""Source files that do not parse.

Files are lexed into one row per terminal. Rows of a file stay in one partition, sorted, so windows need no further shuffle:
- each different pair of neighbours of a file is anti-joined against the pairs that the grammar permits;
- running sums over opening and closing brackets give each terminal its depth and its enclosing bracket, which checks nesting;
- per enclosing bracket, the terminals that stand directly in it are reduced to one production, which the grammar's automaton for
  that bracket accepts or not.
A file is at fault if any of the three fails.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, BooleanType, ShortType

from ..session import cut
from .grammars import PARTNER, SOURCES, grammar
from .lexing import LANGUAGES, lex

_BEGIN, _END = "^", "$"
#: Terminals aimed at in one task: as arrays they are small, as rows in a sort they are not.
TASK_TOKENS = 500_000
#: Numbers that stand for the languages in the rows of terminals.
_LANGS = tuple(sorted(SOURCES))


def plain_language(lang: Column) -> Column:
    """One spelling of a language's name; null for languages without a grammar."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(known, F.lower(F.trim(lang)))


def distinct_files(blobs: DataFrame) -> DataFrame:
    """(f1, f2, blob_oid, lang, content): each content once per language. f1 and f2 name it in 128 bits and partition it."""
    b = blobs.select("blob_oid", plain_language(F.col("lang")).alias("lang"), "content").where(F.col("blob_oid").isNotNull() & F.col("lang").isNotNull() & F.col("content").isNotNull())
    named = b.withColumn("f1", F.xxhash64("blob_oid", "lang")).withColumn("f2", F.xxhash64("lang", F.lit(1), "blob_oid"))
    return named.groupBy("f1", "f2").agg(F.min("blob_oid").alias("blob_oid"), F.min("lang").alias("lang"), F.min("content").alias("content"))


@F.pandas_udf(ArrayType(ShortType()))
def _lexed(lang: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([np.fromiter(map(ord, grammar(l).text([_BEGIN, *lex(l, c), _END])), np.int16) for l, c in zip(lang, content)], dtype=object)


@F.pandas_udf(BooleanType())
def _fits(lang: pd.Series, before: pd.Series, opener: pd.Series, content: pd.Series) -> pd.Series:
    out, known = [], {}
    for l, b, o, c in zip(lang, before, opener, content):
        key = (l, b, o, c.tobytes())
        ok = known.get(key)
        if ok is None:
            g = grammar(_LANGS[l])
            text = "".join(map(chr, c))
            if o < 0:
                ok = g.fits(None, text[1:-1])
            else:
                rule = g.level(chr(b), chr(o))
                ok = rule is None or g.fits(rule, text)  # a bracket that must not stand there is a wrong pair already
            known[key] = ok
        out.append(ok)
    return pd.Series(out)


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Fixed tables of the grammars: permissible pairs (lang, tok, nxt), and brackets (lang, tok, turn, partner)."""
    pairs, brackets = [], []
    for i, lang in enumerate(_LANGS):
        g = grammar(lang)
        pairs += [(i, ord(g.chars[a]), ord(g.chars[b])) for a, b in g.pairs]
        for o, c in PARTNER.items():
            brackets += [(i, ord(g.chars[o]), 1, ord(g.chars[c])), (i, ord(g.chars[c]), -1, ord(g.chars[o]))]
    return spark.createDataFrame(pairs, "lang int, tok short, nxt short"), spark.createDataFrame(brackets, "lang int, tok short, turn int, partner short")


def lexed(files: DataFrame) -> DataFrame:
    """(f1, f2, lang, toks): the terminals of each file between a begin and an end mark, as numbers. Files are lexed once, into a table."""
    code = (F.array_position(F.array(*[F.lit(x) for x in _LANGS]), F.col("lang")) - 1).cast("int")
    return cut(files.select("f1", "f2", code.alias("lang"), _lexed("lang", "content").alias("toks")))


def tokens(arrays: DataFrame) -> DataFrame:
    """(f1, f2, lang, pos, tok): a row per terminal; all rows of a file in one partition. What travels there is the array, before it becomes rows."""
    total = arrays.agg(F.sum(F.size("toks"))).first()[0] or 0
    return arrays.repartition(max(1, -(-total // TASK_TOKENS)), "f1", "f2").select("f1", "f2", "lang", F.posexplode("toks").alias("pos", "tok"))


def wrong_neighbours(arrays: DataFrame) -> DataFrame:
    """(f1, f2) of files with a terminal whose successor the grammar doesn't permit. Each pair of a file is a row once, where the file lies."""
    pairs, _ = _tables(arrays.sparkSession)
    # a pair as one number, as sets of numbers are hashed and sets of structs are not; terminals are small numbers from 0 on
    pair = F.expr("array_distinct(zip_with(slice(toks, 1, size(toks) - 1), slice(toks, 2, size(toks) - 1), (a, b) -> shiftleft(int(a), 16) | (int(b) & 65535)))")
    each = arrays.select("f1", "f2", "lang", F.explode(pair).alias("x"))
    next_ = each.select("f1", "f2", "lang", F.shiftright("x", 16).cast("short").alias("tok"), F.expr("cast(x & 65535 as smallint)").alias("nxt"))
    return next_.join(F.broadcast(pairs), ["lang", "tok", "nxt"], "left_anti").select("f1", "f2").distinct()  # the grammars fix the size of pairs


def wrong_structure(toks: DataFrame) -> DataFrame:
    """(f1, f2) of files whose brackets don't nest, or with a bracket that holds what is no production."""
    _, brackets = _tables(toks.sparkSession)
    whole = W.partitionBy("f1", "f2").orderBy("pos")
    t = toks.join(F.broadcast(brackets), ["lang", "tok"], "left")  # eight rows per grammar
    t = t.withColumn("depth", F.sum(F.coalesce("turn", F.lit(0))).over(whole).cast("int")).withColumn("before", F.lag("tok").over(whole))
    # a bracket's head stands at the depth inside it; the bracket as a whole is one terminal at the depth around it
    turn, depth = F.col("turn"), F.col("depth")
    HEAD, IN, TAIL = 0, 1, 2
    place = lambda level, role: F.struct(level.alias("level"), F.lit(role).alias("role"))
    t = t.withColumn("x", F.explode(F.when(turn == 1, F.array(place(depth, HEAD), place(depth - 1, IN))).when(turn == -1, F.array(place(depth + 1, TAIL))).otherwise(F.array(place(depth, IN)))))
    t = t.select("f1", "f2", "lang", "pos", "tok", "x.*", F.when(F.col("x.role") == HEAD, F.struct("pos", "tok", "before", "partner")).alias("own"))
    level = W.partitionBy("f1", "f2", "level").orderBy("pos", "role")
    t = t.withColumn("head", F.last("own", True).over(level)).withColumn("head", F.when(F.col("level") > 0, F.col("head")))
    groups = t.groupBy("f1", "f2", "level", F.col("head.pos").alias("at")).agg(
        F.first("lang").alias("lang"),
        F.first("head.tok").alias("opener"),
        F.first("head.before").alias("opened_after"),
        F.max(F.when(F.col("role") == TAIL, (F.col("tok") != F.coalesce("head.partner", F.lit(-1))).cast("int"))).alias("crossed"),
        F.count(F.when(F.col("role") == TAIL, 1)).alias("tails"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == IN, F.struct("pos", "tok")))), lambda s: s["tok"]).alias("content"),
    )
    broken = (F.col("level") < 0) | (F.col("crossed") == 1) | ((F.col("level") > 0) & (F.col("at").isNull() | (F.col("tails") != 1))) | ((F.col("level") == 0) & (F.col("tails") > 0))
    groups = groups.withColumn("broken", F.coalesce(broken, F.lit(False)))
    # what nests wrongly has no productions to speak of
    ok = F.when(F.col("broken"), F.lit(False)).otherwise(_fits("lang", F.coalesce("opened_after", F.lit(-1)), F.coalesce("opener", F.lit(-1)), "content"))
    return groups.where(~ok).select("f1", "f2").distinct()


def invalid(blobs: DataFrame) -> DataFrame:
    """(blob_oid, lang) of the contents that are not valid syntax for their language (in its plain spelling).

    Rows with a null blob_oid or content and languages without a grammar are left out; repeated rows count once; an empty content is valid
    where the language allows an empty file. Of several contents under one id and language the smallest counts.
    """
    files = distinct_files(blobs)
    arrays = lexed(files)
    at_fault = cut(wrong_neighbours(arrays).unionByName(wrong_structure(tokens(arrays))).distinct(), drop=arrays)
    return files.select("f1", "f2", "blob_oid", "lang").join(at_fault, ["f1", "f2"], "left_semi").select("blob_oid", "lang")


def rates(blobs: DataFrame, manifest: DataFrame, graphs: DataFrame) -> DataFrame:
    """(repo, lang, n_files, n_invalid, rate): distinct contents of a repository's snapshots per language, and how many don't parse.

    Blobs without content can't be judged and aren't counted; manifest rows without path or blob and graphs without repo are left out.
    """
    bad = invalid(blobs).withColumn("bad", F.lit(1))
    files = distinct_files(blobs).select("blob_oid", "lang")
    repos = graphs.where(F.col("repo").isNotNull()).select("graph_id", "repo").distinct()
    used = manifest.where(F.col("blob_oid").isNotNull()).select("graph_id", "blob_oid").distinct().join(repos, "graph_id").select("repo", "blob_oid").distinct()
    each = used.join(files, "blob_oid").join(bad, ["blob_oid", "lang"], "left")
    out = each.groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_invalid"))
    return out.withColumn("rate", F.col("n_invalid") / F.col("n_files"))
