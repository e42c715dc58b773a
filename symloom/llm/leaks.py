"""Evaluation texts leaking into training text: Wu-Manber search over words.

A pattern is a window of SPAN consecutive words of an item. Items are taken in blocks of bounded size; of each block tables are
built once on the driver: the shift table says, for two consecutive words, how far the search may skip (SPAN - 1 words where
they occur in no pattern), and where the shift is 0 a bucket of patterns with these last two words is looked up, narrowed
by the first two words and compared word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row that make a leak.
SPAN = 12
#: Characters of items in one block of patterns; bounds what a task holds.
BLOCK_CHARS = 4_000_000
#: Letters and digits only; `_` separates.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class Patterns:
    """Wu-Manber tables over the windows of SPAN words of some items."""

    def __init__(self, items: list[tuple[int, str]], span: int = SPAN):
        self.span = span
        self.code: dict[str, int] = {}
        self.shift: dict[tuple[int, int], int] = {}
        self.bucket: dict[tuple[int, int], dict[tuple[int, int], list[tuple[tuple[int, ...], set[int]]]]] = {}
        for item, text in items:
            ids = [self.code.setdefault(w, len(self.code)) for w in words(text)]
            for i in range(len(ids) - span + 1):
                self._add(tuple(ids[i : i + span]), item)

    def _add(self, pattern: tuple[int, ...], item: int) -> None:
        n = self.span
        for j in range(1, n):
            pair = (pattern[j - 1], pattern[j])
            self.shift[pair] = min(self.shift.get(pair, n - 1), n - 1 - j)
        heads = self.bucket.setdefault(pattern[-2:], {}).setdefault(pattern[:2], [])
        for known, owners in heads:
            if known == pattern:
                owners.add(item)
                return
        heads.append((pattern, {item}))

    def search(self, text: str) -> set[int]:
        """Items of which SPAN words in a row stand in the text."""
        n, found = self.span, set()
        get, shift, far = self.code.get, self.shift.get, self.span - 1
        ids = [get(w, -1) for w in words(text)]
        i, end = n - 1, len(ids)
        while i < end:
            skip = shift((ids[i - 1], ids[i]), far)
            if skip:
                i += skip
                continue
            for pattern, owners in self.bucket[ids[i - 1], ids[i]].get((ids[i - n + 1], ids[i - n + 2]), ()):
                if tuple(ids[i - n + 1 : i + 1]) == pattern:
                    found |= owners
            i += 1
        return found


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id): the document holds at least `span` words in a row that stand in a row in the item.

    Every document is read whole, once per block of items. Null texts, texts shorter than `span` words and rows without id give no
    row; repeated rows give one. Columns other than the ids and `text` are ignored.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    held = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    size = held.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    out = None
    for b in range(blocks):
        # about block_chars characters of items at once, as the hash spreads them
        rows = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        tables = spark.sparkContext.broadcast(Patterns([(r["item_id"], r["text"]) for r in rows], span))

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            search = tables.value.search
            for x in batches:
                ids, found = [], []
                for doc, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                    for item in search(text):
                        ids.append(doc)
                        found.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

        part = docs.mapInArrow(run, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
