"""Rounds of questions and answers between chunks of rows and buckets of keys.

A chunk is one table row that holds some megabytes as arrays. In a round each chunk sends, to each bucket of a key space, what it
has there as one packed piece; a bucket compares the pieces of all chunks and answers each chunk in the order it asked. So
Spark partitions, shuffles and retries the work, and a shuffled row is thousands of keys. A chunk sends equal keys once, so
no key makes a bucket large, however many rows have it. Chunks and buckets both follow the input, so the number of pieces follows
its square: what a piece costs besides its keys is kept small, and ``widely`` makes buckets larger where there are many.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_KEYS = 1_500_000
MOST_BUCKETS = 1 << 14
MANY_BUCKETS = 128
WIDER = 4
REPLY_BYTES = 1 << 22
SENT = "array<struct<bucket:int,data:binary>>"

Arrays = dict[str, np.ndarray]


_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()  # made once: a new one costs more than a small piece


def _planes(values: np.ndarray) -> np.ndarray | None:
    """The lowest bytes of all numbers, then their second ones and so on, as far as the largest number has any; None if that leaves no byte out."""
    size = values.dtype.itemsize
    if size == 1 or values.dtype.kind not in "iu" or not len(values) or (values.dtype.kind == "i" and values.min() < 0) or (need := max(1, -(-int(values.max()).bit_length() // 8))) == size:
        return None
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, size)[:, :need].T)


def pack(arrays: Arrays) -> bytes:
    """A line of names, kinds, lengths and planes, then the bytes of each array. Numbers that leave upper bytes empty are written as planes of bytes;
    each plane is a block that is compressed by itself, so planes take about their entropy."""
    head, parts = [], [b""]
    for name, values in arrays.items():
        planes = _planes(values)
        head.append(f"{name} {values.dtype.str} {len(values)} {0 if planes is None else len(planes)}")
        parts += [values.tobytes()] if planes is None else [p.tobytes() for p in planes]
    parts[0] = ",".join(head).encode() + b"\n"
    packing, out = _COMPRESSOR.compressobj(size=sum(map(len, parts))), []
    for part in parts:
        out += (packing.compress(part), packing.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK))
    return b"".join([*out, packing.flush()])


def unpack(data: bytes) -> Arrays:
    held, out = _DECOMPRESSOR.decompress(data), {}
    at = held.index(b"\n") + 1
    for field in held[: at - 1].decode().split(",") if at > 1 else ():
        name, kind, length, planes = field.split(" ")
        kind, length, planes = np.dtype(kind), int(length), int(planes)
        if planes:
            whole = np.zeros((length, kind.itemsize), np.uint8)
            whole[:, :planes] = np.frombuffer(held, np.uint8, planes * length, at).reshape(planes, length).T
            out[name], at = whole.reshape(-1).view(kind), at + planes * length
        else:
            out[name], at = np.frombuffer(held, kind, length, at).copy(), at + length * kind.itemsize
    return out


def gaps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, which take little room when packed; ``np.cumsum`` is the way back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def buckets_for(keys: float, each: int = BUCKET_KEYS) -> int:
    """Buckets of about ``each`` keys, and larger ones beyond MOST_BUCKETS of them."""
    return max(1, min(MOST_BUCKETS, math.ceil(keys / each)))


def widely(keys: float, each: int = BUCKET_KEYS) -> int:
    """``buckets_for`` keys that a task looks at by ``shares``: beyond MANY_BUCKETS buckets have up to WIDER times ``each`` keys."""
    return max(buckets_for(keys, each * WIDER), min(MANY_BUCKETS, buckets_for(keys, each)))


def shares(keys: np.ndarray, each: int = BUCKET_KEYS // 2) -> Iterator[np.ndarray]:
    """The places of hashes in shares of about ``each``, equal ones in one share: what comparing takes besides is held for one share at a time."""
    parts = -(-len(keys) // each)
    if parts < 2:
        yield np.arange(len(keys))
        return
    which = keys.astype(np.uint16)
    which >>= np.uint16(1)
    which %= np.uint16(parts)
    for k in range(parts):
        yield np.flatnonzero(which == k)


def ascending(pieces: list[Arrays]) -> tuple[np.ndarray, list[int]]:
    """What the pieces' ``gaps`` were made of, as 64-bit numbers, and the bounds of each piece; the gaps are gone then, as they take as much room."""
    edges = np.cumsum([0, *[len(p["gaps"]) for p in pieces]]).tolist()
    out = np.empty(edges[-1], np.uint64)
    for p, a, b in zip(pieces, edges[:-1], edges[1:], strict=True):
        np.cumsum(p.pop("gaps"), dtype=np.uint64, out=out[a:b])
    return out, edges


def answer(states: DataFrame, compare: Callable[[list[Arrays]], list[Arrays | None]]) -> DataFrame:
    """(chunk, got): the answers to what ``states`` (chunk, sent) have sent. ``compare`` takes a bucket's pieces, in any order, and
    gives an answer, or None, for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks, pieces, held, size = None, [], [], [], 0

        def replies() -> pa.RecordBatch:
            columns = zip(zip(*held, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["chunk", "bucket", "data"])

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            for chunk, reply in zip(chunks, compare(pieces), strict=True):
                if reply is not None:
                    held.append((chunk, now, pack(reply)))
                    size += len(held[-1][2])
                    if size >= REPLY_BYTES:
                        yield replies()
                        held, size = [], 0

        for batch in batches:
            for bucket, chunk, data in zip(*batch.columns, strict=True):
                if bucket.as_py() != now:
                    if pieces:
                        yield from emit()
                    now, chunks, pieces = bucket.as_py(), [], []
                chunks.append(chunk.as_py())
                pieces.append(unpack(data.as_py()))
        if pieces:
            yield from emit()
        if held:
            yield replies()

    rows = states.select("chunk", F.explode("sent").alias("s")).select("s.bucket", "chunk", "s.data")
    replies = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, bucket int, data binary")
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias("got"))


def sent(pieces: list[tuple[int, Arrays]]) -> list[dict]:
    return [{"bucket": int(b), "data": pack(a)} for b, a in pieces]


def received(got) -> dict[int, Arrays]:
    return {x["bucket"]: unpack(x["data"]) for x in got or ()}


def lexicographic(keys: list[np.ndarray]) -> np.ndarray:
    """The order by several columns, the first one first; later columns are looked at where earlier ones tie only."""
    order = np.argsort(keys[0], kind="stable")
    first = keys[0][order]
    same = first[1:] == first[:-1]
    if len(keys) == 1 or not same.any():
        return order
    tied = np.concatenate((same, [False])) | np.concatenate(([False], same))
    at = np.flatnonzero(tied)
    own = order[at]
    order[at] = own[np.lexsort([k[own] for k in reversed(keys)])]
    return order


def starts_of(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Whether each row, in ``order``, differs from the one before it."""
    fresh = np.ones(len(order), bool)
    if len(order) > 1:
        fresh[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return fresh
