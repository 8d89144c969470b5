"""A count-min sketch of 64-bit hashes that is neither collected nor broadcast, however large it grows.

Each task adds the hashes of its rows to a sketch of ``DEPTH`` rows whose counters stop at two and sends the counters it
touched, sorted and packed, by segment. A segment is merged by a streaming fold, one at a time, which holds only counters that
are not zero. The cells that reached two come out as rows, and hashes are tested by semi-joins on their cells, which Spark
plans by size and splits when skewed. A sketch overestimates only: a hash that is not estimated repeated occurs once.

The number of cells follows the number of hashes, ``CELLS_PER_HASH`` a row at least, without a bound: at any size less than one
in 200 of the hashes that occur once is estimated repeated.

``Marks`` is the other way round: a bit map of bounded size that is broadcast, to keep rows out of a shuffle. Beyond its size more
rows pass; they find no partner in the join that follows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 2
CELLS_PER_HASH = 16.0
SEGMENT_BITS = 22
MOST_SEGMENTS_BITS = 16
CHUNK = 1_000_000
MARK_BITS = 16
MOST_MARKS = 28

_PACKED = "row int, segment long, once binary, more binary"


def bits_for(hashes: float, cells: float = CELLS_PER_HASH) -> int:
    """Bits of a cell's number, for about this many hashes."""
    return min(56, max(10, math.ceil(math.log2(max(2.0, cells * hashes)))))


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The first row takes a hash's upper bits, the second its lower ones."""
    return hashes >> np.uint64(64 - bits) if row == 0 else hashes & np.uint64((1 << bits) - 1)


def cell(hashed: Column, row: int, bits: int) -> Column:
    """``_cells`` as an expression."""
    return F.shiftrightunsigned(hashed, 64 - bits) if row == 0 else hashed.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def segment_bits(bits: int) -> int:
    """Bits of a cell's number within its segment."""
    return max(min(SEGMENT_BITS, bits), bits - MOST_SEGMENTS_BITS)


def _pack(cells: np.ndarray) -> bytes:
    gaps = np.diff(cells, prepend=cells.dtype.type(0))
    most = int(gaps.max()) if len(gaps) else 0
    kind = np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(1).compress(gaps.astype(kind).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64))


def _packed(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    width = segment_bits(bits)
    out: dict[str, list] = {"row": [], "segment": [], "once": [], "more": []}
    for row in range(DEPTH):
        cells = np.sort(_cells(hashes, row, bits))
        same = cells[1:] == cells[:-1]
        new = np.concatenate(([True], ~same))
        twice, cells = np.append(same, False)[new], cells[new]
        segments = cells >> np.uint64(width)
        starts = np.flatnonzero(np.concatenate(([True], segments[1:] != segments[:-1])))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True):
            own, more = cells[a:b] & np.uint64((1 << width) - 1), twice[a:b]
            out["row"].append(row)
            out["segment"].append(int(segments[a]))
            out["once"].append(_pack(own[~more]))
            out["more"].append(_pack(own[more]))
    return pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int32()), pa.array(out["segment"], pa.int64()), pa.array(out["once"], pa.binary()), pa.array(out["more"], pa.binary())], names=list(out))


class _Counters:
    """Cells of one segment that were reached once, and those reached more often."""

    def __init__(self):
        self.held, self.size, self.twice = [], 0, []

    def add(self, once: np.ndarray, more: np.ndarray) -> None:
        self.held.append(once)
        self.twice.append(more)
        self.size += len(once) + len(more)
        if self.size > CHUNK:
            self.fold()
            self.size = 0

    def fold(self) -> np.ndarray:
        cells = np.sort(np.concatenate(self.held))
        repeated = np.unique(np.concatenate([*self.twice, cells[1:][cells[1:] == cells[:-1]]]))
        self.held, self.twice = [np.setdiff1d(cells, repeated)], [repeated]
        return repeated


def _merge(bits: int):
    """Folds the packed counters of rows sorted by segment; gives the cells that reached two."""

    def repeated(at: tuple[int, int], counters: _Counters) -> pa.RecordBatch:
        cells = counters.fold() + (at[1] << segment_bits(bits))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), at[0], np.int32)), pa.array(cells)], names=["row", "cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counters = None, _Counters()
        for batch in batches:
            for row, segment, once, more in zip(*(batch.column(i) for i in range(4)), strict=True):
                at = row.as_py(), segment.as_py()
                if at != now:
                    if now is not None:
                        yield repeated(now, counters)
                    now, counters = at, _Counters()
                counters.add(_unpack(once.as_py()), _unpack(more.as_py()))
        if now is not None:
            yield repeated(now, counters)

    return run


def repeated_cells(rows: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> DataFrame:
    """(row, cell) of the cells that the hashes of ``rows`` reach twice; ``hashes`` gives them as arrays of uint64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in hashes(batches):
            if len(found):
                held.append(found)
                n += len(found)
            if n >= CHUNK:
                yield _packed(np.concatenate(held), bits)
                held, n = [], 0
        if n:
            yield _packed(np.concatenate(held), bits)

    sent = rows.mapInArrow(run, _PACKED).repartition("row", "segment").sortWithinPartitions("row", "segment")
    return sent.mapInArrow(_merge(bits), "row int, cell long")


def estimated_repeated(rows: DataFrame, hash_col: str, cells: DataFrame, bits: int) -> DataFrame:
    """The ``rows`` whose hash may occur twice: all its cells are among ``cells``."""
    for row in range(DEPTH):
        held = cells.where(F.col("row") == row).select(F.col("cell").alias("__cell"))
        rows = rows.join(held, cell(F.col(hash_col), row, bits) == F.col("__cell"), "left_semi")
    return rows


class Marks:
    """Bits of keys, ``MARK_BITS`` for each up to ``2 ** MOST_MARKS`` in all (32 MB), sent to all executors."""

    def __init__(self, keys: DataFrame, most: int = MOST_MARKS):
        """``keys`` has one column of 64-bit hashes."""
        self.bits = bits = min(most, bits_for(keys.count(), MARK_BITS))
        width = min(SEGMENT_BITS, bits)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = np.unique(_cells(batch.column(0).to_numpy().view(np.uint64), 0, bits))
                for k in np.unique(cells >> np.uint64(width)).tolist():
                    own = cells[cells >> np.uint64(width) == k] & np.uint64((1 << width) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_pack(own)], pa.binary())], names=["segment", "cells"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, np.ndarray] = {}
            for batch in batches:
                for segment, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen.setdefault(segment, np.zeros(1 << width, bool))[_unpack(cells)] = True
            for segment, marked in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([np.packbits(marked).tobytes()], pa.binary())], names=["segment", "bits"])

        parts = keys.mapInArrow(mark, "segment long, cells binary").repartition("segment").mapInArrow(merge, "segment long, bits binary").collect()
        held, step = np.zeros((1 << bits) >> 3, np.uint8), (1 << width) >> 3
        for segment, data in parts:
            held[segment * step : (segment + 1) * step] = np.frombuffer(data, np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(held)

    def __getstate__(self):
        return {"bits": self.bits, "sent": self.sent}

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        cells = _cells(keys.view(np.uint64), 0, self.bits)
        return (self.sent.value[cells >> np.uint64(3)] >> (np.uint64(7) - (cells & np.uint64(7))).astype(np.uint8)) & 1 > 0

    def part(self, rows: DataFrame, key_col: str, marked: bool) -> DataFrame:
        """The ``rows`` whose key may be among the marked ones, or all others."""
        at = rows.columns.index(key_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(self.may_hold(batch.column(at).to_numpy()) == marked))

        return rows.mapInArrow(run, rows.schema)
