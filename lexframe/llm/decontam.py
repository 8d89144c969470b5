"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``WINDOW`` consecutive words of the benchmark items (an item of fewer words is one
window). For each pattern length there is a table of block shifts: how far the scan may jump when it sees a block of
``BLOCK`` words, the full distance for a block in no pattern. At shift zero the bucket of that suffix block, divided by
the patterns' first word, names the candidates, and only a direct comparison of all words confirms an occurrence.

Different benchmark texts are collected in blocks of at most about ``max_block_bytes`` (one item cannot be divided), one block at a time:
its hits are written and its tables released before the next is fetched, so driver and executors hold one block however large
the benchmark is. With one block the search only maps the documents, with more the documents are searched once for each block
and the hits of a document are merged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8

WINDOW = 10
BLOCK = 3
MAX_BLOCK_BYTES = 4_000_000
CELLS_PER_BLOCK = 16

#: ASCII letters in lower case and digits stay, bytes of other characters stay, the rest parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Patterns:
    """Shift tables and suffix buckets of one pattern length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(BLOCK, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[bytes, list]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.bucket.setdefault(words[length - self.block :], {}).setdefault(words[0], []).append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence."""
        shift, jump, block, length, n = self.shift.get, self.jump, self.block, self.length, len(words)
        at = length
        while at <= n:
            key = tuple(words[at - block : at])
            if step := shift(key, jump):
                at += step
                continue
            start = at - length
            for pattern, items in self.bucket[key].get(words[start], ()):
                if words[start:at] == pattern:
                    yield start, items
            at += 1


def compile_patterns(items: list[tuple[str | None, bytes | None]]) -> list[Patterns]:
    """Tables for (item_id, text) pairs, one for each length that occurs."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = tuple(words_of(text))
        length = min(WINDOW, len(words))
        for start in range(len(words) - length + 1 if length else 0):
            found = by_length.setdefault(length, {}).setdefault(words[start : start + length], set())
            if item is not None:
                found.add(item)
    return [Patterns(length, patterns) for length, patterns in sorted(by_length.items())]


def occurrences(tables: list[Patterns], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged [start, stop) ranges of hit words in order, and the items with an occurring window."""
    spans, items = [], set()
    for table in tables:
        for start, found in table.search(words):
            spans.append((start, start + table.length))
            items |= found
    return merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged


class _Tables:
    """Sends a block of items; each Python worker compiles it once."""

    _compiled: dict[int, list[Patterns]] = {}

    def __init__(self, spark, items: list[tuple[str | None, bytes | None]]):
        self.items = spark.sparkContext.broadcast(items)
        self.key = self.items._jbroadcast.id() if hasattr(self.items, "_jbroadcast") else id(items)

    def __getstate__(self):
        return {"items": self.items, "key": self.key}

    def get(self) -> list[Patterns]:
        if self.key not in _Tables._compiled:
            _Tables._compiled.clear()
            _Tables._compiled[self.key] = compile_patterns(self.items.value)
        return _Tables._compiled[self.key]


def _blocks(items: DataFrame, id_col: str, text_col: str, max_block_bytes: int) -> tuple[DataFrame, int]:
    """(different items as (id, text, block), number of blocks). Blocks are filled by a running sum in the order of a hash, cell by
    cell, so a block exceeds its bound by one cell of items at the most; repeated rows count once."""
    slim = items.select(F.col(id_col).cast("string").alias("id"), utf8(text_col).alias("text"))
    once = slim.dropDuplicates(["id", "text"])
    size = once.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0
    if size <= max_block_bytes:
        return once.select("id", "text", F.lit(0).alias("block")), 1
    cells = max(1, math.ceil(size / max_block_bytes)) * CELLS_PER_BLOCK
    placed = cut(once.withColumn("cell", F.pmod(F.xxhash64("id", "text"), F.lit(cells)).cast("int")), "items")
    filled, room, block, of = 0, max_block_bytes, 0, {}
    for cell, own in sorted(placed.groupBy("cell").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).collect()):  # CELLS_PER_BLOCK rows a block
        if filled and filled + own > room:
            block, filled = block + 1, 0
        of[cell], filled = block, filled + own
    bounds = [min(c for c in of if of[c] == b) for b in range(1, block + 1)]
    number = F.aggregate(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<int>"), F.lit(0), lambda n, c: n + (c <= F.col("cell")).cast("int"))
    return placed.select("id", "text", number.alias("block")), block + 1


def _block(items: DataFrame, k: int) -> _Tables:
    """The k-th block, of bounded size."""
    rows = items.where(F.col("block") == k).select("id", "text").collect()
    return _Tables(items.sparkSession, [(r[0], None if r[1] is None else bytes(r[1])) for r in rows])


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans).

    ``spans`` are the hit words as [start, stop) pairs, ``items`` the sorted ids. Null and wordless texts have no words
    and no hits, long ones are searched whole. Items with a null id are searched for but not listed; rows that repeat an item id add to that item.
    """
    blocks, n = _blocks(items, item_col, item_text_col, max_block_bytes)
    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def scan(tables: _Tables, only_hits: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, spans, names, keep = [], [], [], []
                for i, text in enumerate(batch.column(1)):
                    own = words_of(text.as_py())
                    hit, found = occurrences(tables.get(), own)
                    if hit or not only_hits:
                        keep.append(i)
                        words.append(len(own))
                        spans.append([x for s in hit for x in s])
                        names.append(sorted(found))
                ids = batch.column(0).take(pa.array(keep, pa.int64()))
                texts = batch.column(1).take(pa.array(keep, pa.int64()))
                key = pa.array([hashlib.md5(t.as_py() or b"").hexdigest() if only_hits else None for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([ids, key, pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "key", "n_words", "spans", "items"])

        return run

    schema = f"doc_id {kind}, key string, n_words long, spans array<int>, items array<string>"
    if n == 1:
        found = slim.mapInArrow(scan(_block(blocks, 0), False), schema)
    else:
        parts = []
        for k in range(n):
            tables = _block(blocks, k)
            parts.append(cut(slim.mapInArrow(scan(tables, True), schema), "hits").withColumn("part", F.lit(k)))
            tables.items.destroy()
        hits = reduce(DataFrame.unionByName, parts).dropDuplicates(["doc_id", "key", "part"])
        merged = hits.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        own = slim.mapInArrow(_count_words, f"doc_id {kind}, key string, n_words long")
        match = own["doc_id"].eqNullSafe(merged["doc_id"]) & (own["key"] == merged["key"])
        found = own.join(merged, match, "left").select(own["doc_id"], own["key"], "n_words", F.coalesce("spans", F.array().cast("array<int>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return found.mapInArrow(_summarise, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:int,stop:int>>")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.md5(t).hexdigest() for t in texts], pa.string()), pa.array([len(words_of(t)) for t in texts], pa.int64())], names=["doc_id", "key", "n_words"])


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, items = batch.column(3).to_pylist(), batch.column(4)
        spans = [merge_spans(list(zip(x[::2], x[1::2], strict=True))) for x in flat]
        hit = [sum(b - a for a, b in x) for x in spans]
        lists = items.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(hit, pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array([_digest(x) for x in lists], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), items,
             pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
        )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, columns unchanged. Each block of items filters in turn.

    Null and wordless texts stay, null items match nothing, repeated rows are judged alike; with an empty benchmark all stay.
    """
    at, (blocks, n) = docs.columns.index(text_col), _blocks(items, item_col, item_text_col, max_block_bytes)
    for k in range(n):
        tables = _block(blocks, k)

        def clean(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not any(next(t.search(words), None) for t in tables.get()) for words in (words_of(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(at))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
        if n > 1:
            docs = cut(docs, "uncontaminated")
            tables.items.destroy()
    return docs
