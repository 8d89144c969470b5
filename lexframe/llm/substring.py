"""Repeated passages of words, found exactly behind a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. Its anchor is the least hash among its runs of ``GRAM`` words. If a
window occurs twice, its anchor lies at two places, so the number of an anchor's places overestimates the counts of its
windows, and there are seven times fewer of them than windows. First pass: the partitions' sketches of anchors are merged
(see ``sketch``). Second pass: anchors estimated repeated are named to their documents, and the windows that have one, and
only these, are grouped exactly; tasks first settle what repeats within ``CHUNK`` windows, so a window that a third of
all documents share makes a row for each chunk, not for each occurrence. The first occurrence in the order of (doc_id,
place) stays. Sketches, anchors and windows go by shuffles only; what
is broadcast are bit maps of documents, of at most 32 MB.

Windows are grouped by two 64-bit hashes, both made of one 64-bit hash per word. Two of V different words are confused with a
probability of at most V**2 / 2**65 (V = 10**8: 0.03 %), two of N different windows with N**2 / 2**129.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .common import cut, discard, utf8

WINDOW = 20
GRAM = 8
CHUNK = 1_000_000
SLICE_BYTES = 1_000_000
BYTES_PER_ANCHOR = 42
LAST = 2**63 - 1

_M1, _M2, _MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


def _roll(base: np.ndarray, m: np.uint64, length: int) -> np.ndarray:
    """Polynomial hash of every ``length`` consecutive values, by doubling."""
    out, have, power, weight = None, 0, base, 1
    multiplier, left = int(m), length
    total = len(base) - length + 1
    while left:
        factor = np.uint64(multiplier)
        if left & 1:
            part = power[have : have + total]
            out = part.copy() if out is None else out * factor + part
            have += weight
        left >>= 1
        if left:
            power = power[:-weight] * factor + power[weight:]
            multiplier = multiplier * multiplier % (1 << 64)
            weight *= 2
    return out


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def _extreme(values: np.ndarray, length: int, pick: Callable) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``length`` consecutive values, by doubling."""
    have, total = 1, len(values) - length + 1
    while 2 * have <= length:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[:total], values[length - have : length - have + total])


class Windows:
    """Windows and anchors of tokenised texts: ``owner`` is a text's number, ``place`` a window's first word."""

    def __init__(self, texts: list[list[bytes]]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(sizes.sum())
        if total < WINDOW or sizes.max() < WINDOW:
            self.base = self.owner = self.place = np.zeros(0, np.int64)
            self.least = self.anchors = np.zeros(0, np.uint64)
            self.anchor_owner = self.whole = np.zeros(0, np.int64)
            return
        digest = xxhash.xxh64_intdigest
        self.base = np.fromiter((digest(w) for words in texts for w in words), np.uint64, total)
        ends, start = np.cumsum(sizes), np.arange(total - WINDOW + 1)
        owners = np.repeat(np.arange(len(texts)), sizes)
        self.whole = start + WINDOW <= ends[owners[: len(start)]]
        grams, span = _finish(_roll(self.base, _M1, GRAM)), WINDOW - GRAM + 1
        least = np.where(self.whole, _extreme(grams, span, np.minimum), np.uint64(0))
        # A place is an anchor if it is the least of some whole window: none of the windows over it has a greater least.
        around = np.zeros(span - 1, np.uint64)
        reached = _extreme(np.concatenate((around, least, around)), span, np.maximum)
        at = np.flatnonzero((reached == grams) & (reached > 0))
        self.anchors, self.anchor_owner = grams[at], owners[at]
        self.owner, start, self.least = owners[: len(start)][self.whole], start[self.whole], least[self.whole]
        self.place = start - (ends - sizes)[self.owner]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of every window."""
        if not len(self.place):
            return self.least, self.least
        other = (self.base ^ (self.base >> np.uint64(31))) * _MIX
        return _finish(_roll(self.base, _M1, WINDOW)[self.whole]), _finish(_roll(other, _M2, WINDOW)[self.whole])


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of about SLICE_BYTES, or one row if that is longer."""
    at, held = 0, 0
    for i, text in enumerate(batch.column(column)):
        held += len(text.as_buffer()) if text.is_valid else 0
        if held >= SLICE_BYTES:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _words(column: pa.Array) -> list[list[bytes]]:
    return [(t.as_py() or b"").split() for t in column]


def _all_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for part in _slices(batch, 0):
            yield Windows(_words(part.column(0))).anchors


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc, tag), once for each document."""
    for batch in batches:
        for part in _slices(batch, 2):
            found = Windows(_words(part.column(2)))
            order = np.lexsort((found.anchors, found.anchor_owner))
            anchor, owner = found.anchors[order], found.anchor_owner[order]
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            anchor, owner = anchor[fresh], pa.array(owner[fresh])
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), part.column(0).take(owner), part.column(1).take(owner)], names=["anchor", "doc", "tag"])


def _candidates(unique: bool):
    names = ["h1", "h2", "doc", "tag", "place", "run"]

    def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, tag, place, h1, h2 = (np.concatenate(x) for x in zip(*held, strict=True))
        if (doc[1:] < doc[:-1]).any() or (doc[1:] == doc[:-1]).any() and not unique:
            order = np.lexsort((place, tag, doc))
            doc, tag, place, h1, h2 = doc[order], tag[order], place[order], h1[order], h2[order]
        order = np.lexsort((h2, h1))  # stable: of equal windows the first occurrence comes first
        same = np.concatenate(([False], (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])))
        # In the order of the documents, in which ids and places take little room when shuffled.
        first = np.sort(order[~same])
        yield pa.RecordBatch.from_arrays([pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int64)), pa.array(doc[first]), pa.array(tag[first]), pa.array(place[first]), pa.array(np.zeros(len(first), np.int32))], names=names)
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        # Of rows that repeat an id and a text, all are the first occurrence if one is.
        again = np.sort(order[same & ((doc[order] != doc[head]) | (tag[order] != tag[head]) | (place[order] != place[head]))])
        if len(again):
            doc, tag, place = doc[again], tag[again], place[again]
            fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] > place[:-1] + 1)))
            at = np.flatnonzero(fresh)
            length = place[np.append(at[1:], len(place)) - 1] - place[at] + 1
            # Settled runs are ranked among themselves; the hashes only spread them.
            spread = (doc[at].view(np.uint64) * _MIX).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(spread), pa.array(doc[at]), pa.array(tag[at]), pa.array(place[at]), pa.array(length)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in _slices(batch, 2):
                found = Windows(_words(part.column(2)))
                named = part.column(3)
                flagged = np.unique(np.asarray(named.flatten(), np.int64).view(np.uint64)) if len(named) else np.zeros(0, np.uint64)
                if not len(found.place) or not len(flagged):
                    continue
                at = np.minimum(np.searchsorted(flagged, found.least), len(flagged) - 1)
                keep = flagged[at] == found.least
                if keep.any():
                    (h1, h2), owner = found.hashes(), found.owner[keep]
                    held.append((part.column(0).to_numpy()[owner], part.column(1).to_numpy()[owner], found.place[keep].astype(np.int32), h1[keep], h2[keep]))
                    n += len(owner)
                if n >= CHUNK // 2:
                    yield from emit(held)
                    held, n = [], 0
        if held:
            yield from emit(held)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests, spans = [], [], [], []
        for text, runs in zip(batch.column(1), batch.column(2), strict=True):
            words = (text.as_py() or b"").split()
            gone: list[list[int]] = []
            for r in sorted((x["place"], x["place"] + x["run"] - 1 + WINDOW) for x in runs.as_py() or ()):
                if gone and r[0] <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], r[1])
                else:
                    gone.append([*r])
            kept, at = [], 0
            for a, b in gone:
                kept += words[at:a]
                at = b
            kept += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            spans.append([{"start": a, "stop": b} for a, b in gone])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: float = sketch.CELLS_PER_HASH) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_removed, kept_sha256, removed), ``removed`` being [start, stop) word ranges.

    A null text has no words, an empty table gives an empty one. Null ids come after all others. Rows that repeat an id but
    not a text are different documents in the order of their text's hash; rows that repeat both are one document and share its
    result. Only the two columns are read, so others may have any names. ``cells`` is the sketch's number of counters for each
    anchor; it changes the cost only.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = sketch.bits_for(size / BYTES_PER_ANCHOR, cells)
    unique = docs.groupBy(id_col).count().where("count > 1").limit(1).count() == 0
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    tag = F.lit(0).cast("long") if unique else F.xxhash64(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"), doc.alias("doc"), tag.alias("tag")).withColumn("key", F.xxhash64("doc", "tag"))
    key = F.xxhash64("doc", "tag").alias("key")

    repeated = cut(sketch.repeated_cells(docs.select(utf8(text_col)), _all_anchors, bits), "cells")
    anchors = sketch.estimated_repeated(texts.select("doc", "tag", "text").mapInArrow(_anchor_rows, "anchor long, doc long, tag long"), "anchor", repeated, bits)
    named = cut(anchors.groupBy("doc", "tag").agg(F.collect_set("anchor").alias("anchors")), "anchors")  # at most one a word

    # Only texts that have such an anchor are shuffled, and below only those that may lose words: marks of bounded size tell.
    near = sketch.Marks(named.select(key)).part(texts.select("doc", "tag", "text", "key"), "key", True)
    rows = near.join(named, ["doc", "tag"]).select("doc", "tag", "text", "anchors").mapInArrow(_candidates(unique), "h1 long, h2 long, doc long, tag long, place int, run int")
    nth = F.rank().over(Window.partitionBy(F.col("run") > 0, "h1", "h2").orderBy("doc", "tag", "place"))
    later = rows.withColumn("nth", nth).where("run > 0 or nth > 1").select("doc", "tag", "place", F.greatest("run", F.lit(1)).alias("run"))
    runs = cut(later.groupBy("doc", "tag").agg(F.collect_list(F.struct("place", "run")).alias("runs")), "runs")  # at most a row a word
    discard(repeated, named)

    kind = texts.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,stop:int>>"
    losing = sketch.Marks(runs.select(key))
    judged = losing.part(texts, "key", True).join(runs, ["doc", "tag"], "left").select("doc_id", "text", "runs").mapInArrow(_remove, out)
    none = F.lit(None).cast(runs.schema["runs"].dataType).alias("runs")
    return judged.unionByName(losing.part(texts.select("doc_id", "text", "key"), "key", False).select("doc_id", "text", none).mapInArrow(_remove, out))
