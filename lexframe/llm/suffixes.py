"""Repeated passages of bytes by a distributed suffix array with a difference cover (after Kärkkäinen, Sanders and Burkhardt, 2006).

A byte goes if a string of ``WINDOW`` bytes over it also starts in a document of a smaller doc_id. Suffixes matter to that
depth only, so their order need not be right beyond it, and one level of recursion is enough.

1. Texts are read once into chunks. Of each window the least hash of its ``GRAM``-byte runs is its anchor; windows whose
   anchor lies in one document only cannot repeat elsewhere and are left out. Runs of the others are cut, at places that their
   content decides, into pieces that share ``WINDOW - 1`` bytes, so that every window is whole in one piece. Equal pieces are
   one piece, of the smallest doc_id: copies, however many, are worked on once.
   Of the pieces' windows those with a hash that occurs once are discarded: in a difference cover's recursion, too, suffixes
   that are unique need not be sorted further (Dementiev, Kärkkäinen, Mehnert and Sanders, 2008). A window is led by the one before it
   if the byte before it is the same wherever it occurs, and the byte after that one too: the two then occur in the same pieces, and
   what is found for the leading window of a run holds for the whole run. Only leading windows are sorted.
2. Pieces are strings of 8-byte characters, in all eight alignments. Characters at places 1 and 2 modulo 3 are the sample, the
   difference cover {1, 2} modulo 3: of any two places one of the shifts by 0, 1 and 2 characters takes both into the sample.
   **Sampled triples** of characters (24 bytes) are sorted over all chunks and named by rank.
3. **Recursion on names**: the sampled suffixes of what is left are sorted by triples of names, 72 bytes deep, and ranked.
4. **Merge**: suffixes at places 0 modulo 3 are sorted by (character, rank of the next sampled suffix) and merged with the sampled
   ones, by comparing (character, rank) with places 1 and (two characters, rank) with places 2.
5. **Adjacent prefixes** of ``WINDOW`` bytes are compared; equal neighbours are one class, with its smallest doc_id.

Sorting is by buckets: ``exchange`` deals keys to buckets (by hash, by sampled splitters, then by names, which grow with their bucket),
each of which is sorted in one task; a chunk sends equal keys once. Hashes are filters that pass too much, never too little;
of what passes adjacent prefixes are compared by a digest of 112 bits. Each piece of text goes to its bucket once, no group is ever expanded into pairs, and only the splitters, at most
``MOST_BUCKETS`` triples drawn from ``SAMPLED``, pass through the driver.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_by, release, utf8
from .exchange import BUCKET_KEYS, SENT, Arrays, answer, ascending, buckets_for, gaps, lexicographic, pack, received, sent, shares, starts_of, unpack, widely

WINDOW = 50
WORD = 8
TRIPLE = 3 * WORD
GRAM = 24
CHUNK_BYTES = 4_000_000
PIECE_CHUNK_BYTES = 2_000_000
BLOCK = 1 << 16
HASH_BITS = 40
DIGEST_BITS = 48
BREAKS = 8
SEVERAL = 255
SAMPLED = 1 << 17
LAST = 2**63 - 1
BYTES_PER_ANCHOR = 13

_SENT_TYPE = pa.list_(pa.struct([("bucket", pa.int32()), ("data", pa.binary())]))
_SPAN = WINDOW - GRAM + 1
_TABLE = np.frombuffer(hashlib.shake_256(b"bytes to 64 bits").digest(2048), "<u8")
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


# --- anchors ------------------------------------------------------------------------------------------------------------------


def _hashes(data: np.ndarray, length: int, bits: int = HASH_BITS) -> np.ndarray:
    """Hashes of ``bits`` bits, never zero, of all runs of ``length`` bytes: sums of powers by doubling, BLOCK runs at a time."""
    total = len(data) - length + 1
    if total > 2 * BLOCK:
        whole = np.empty(total, np.uint64)
        for a in range(0, total, BLOCK):
            whole[a : a + BLOCK] = _hashes(data[a : min(a + BLOCK, total) + length - 1], length, bits)
        return whole
    n, power, width, m, have, out = len(data) - length + 1, _TABLE[data], 1, int(_M1), 0, None
    while True:
        factor = np.uint64(m)
        if length & width:
            part = power[have : have + n]
            out = part.copy() if out is None else out * factor + part
            have += width
        if 2 * width > length:
            break
        power = power[:-width] * factor + power[width:]
        m, width = m * m % (1 << 64), 2 * width
    h = (out ^ (out >> np.uint64(32))) * _M2
    h ^= h >> np.uint64(29)
    h *= _M1
    return (h >> np.uint64(64 - bits)) | np.uint64(1)


def _ordered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of hashes of HASH_BITS bits, and which in that order differ from the one before: hash and place are sorted as one number."""
    width = np.uint64(64 - HASH_BITS)
    if len(hashes) >> int(width):
        order = np.argsort(hashes, kind="stable")
        return order, starts_of([hashes], order)
    both = hashes << width  # changed in place: of millions of numbers each copy counts
    both |= np.arange(len(hashes), dtype=np.uint64)
    both.sort()
    fresh, ascending = np.ones(len(both), bool), both >> width
    np.not_equal(ascending[1:], ascending[:-1], out=fresh[1:])
    both &= (np.uint64(1) << width) - np.uint64(1)
    return both.view(np.int64), fresh


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_distinct`` for hashes of HASH_BITS bits."""
    order, fresh = _ordered(hashes)
    ascending = np.cumsum(fresh)
    ascending -= 1
    number = np.empty(len(order), np.int64)
    number[order] = ascending
    return order, number, order[fresh]


def _extreme(values: np.ndarray, length: int, pick: Callable) -> np.ndarray:
    have, total = 1, len(values) - length + 1
    while 2 * have <= length:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[:total], values[length - have : length - have + total])


def _blocks(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, hashes of grams, places of anchors from there on) for BLOCK windows at a time."""
    total, padding = len(data) - WINDOW + 1, np.zeros(_SPAN - 1, np.uint64)
    for a in range(0, max(0, total), BLOCK):
        b = min(total, a + BLOCK)
        grams = _hashes(data[a : b + WINDOW - 1], GRAM)
        least = _extreme(grams, _SPAN, np.minimum)
        start = np.arange(a, b)
        inside = ends[np.searchsorted(ends, start, "right")] if len(ends) > 1 else ends[0]
        least[start + WINDOW > inside] = 0
        reached = _extreme(np.concatenate((padding, least, padding)), _SPAN, np.maximum)
        yield a, grams, np.flatnonzero(reached == grams)


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all whole windows, in the order of places."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, grams, at in _blocks(data, ends):
        places.append(a + at)
        hashes.append(grams[at])
    at, h = np.concatenate(places), np.concatenate(hashes)
    at, first = np.unique(at, return_index=True)  # neighbouring blocks share some
    return at, h[first]


def _ranges(buckets: int) -> np.ndarray:
    """Where the buckets of hashes begin and the last one ends."""
    return np.array([k * (1 << HASH_BITS) // buckets for k in range(buckets + 1)], np.uint64)


def _by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets among ascending hashes."""
    return np.searchsorted(hashes, _ranges(buckets))


def _anchor_buckets(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): ascending hashes by their lower bits, bucket by bucket. Anchors are least hashes and crowd at the lower end, so buckets of equal
    ranges would have up to ``(_SPAN + 1) / 2`` times the keys of the average one."""
    bucket = ((hashes >> np.uint64(1)) % np.uint64(buckets)).astype(np.uint16)  # the lowest bit is set in all
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _repeated(pieces: list[Arrays]) -> list[Arrays | None]:
    """Which hashes of each piece other pieces have too."""
    h, edges = ascending(pieces)
    found = np.zeros(len(h), bool)
    for at in shares(h):
        order, fresh = _ordered(h[at])
        same = ~fresh[1:]
        found[at[order[1:][same]]] = found[at[order[:-1][same]]] = True
    parts = np.split(found, edges[1:-1])
    return [{"bits": np.packbits(f)} if f.any() else None for f in parts]


def _chunks(kind: pa.DataType, buckets: int, chunk_bytes: int):
    """Rows (doc, doc_id, text) to rows of chunks: one of what stays, and one of their anchors and what is asked of them."""

    def emit(number: int, held: list[tuple[int, object, bytes]]) -> pa.RecordBatch:
        buffer = b"".join(t for _, _, t in held)
        ends = np.cumsum([len(t) for _, _, t in held])
        at, h = _anchors(np.frombuffer(buffer, np.uint8), ends)
        order, fresh = _ordered(h)  # stable, so of equal hashes the first place comes first and the last one last
        owner = np.searchsorted(ends, at[order], "right")
        edge = np.append(np.flatnonzero(fresh), len(order))
        several = owner[edge[:-1]] != owner[edge[1:] - 1]
        hashes = h[order[fresh]]
        dealt, bounds = _anchor_buckets(hashes, buckets)
        keys = (hashes >> np.uint64(1))[dealt] // np.uint64(buckets)  # ascending, and distinct, within a bucket
        asked = sent([(k, {"gaps": gaps(keys[a:b])}) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a])
        anchors = pack({"gaps": gaps(at).astype(np.uint32), "several": np.packbits(several), "buckets": np.array([buckets])})
        values = ([number] * 2, ["state", "sent"], [[d for d, _, _ in held], None], [[i for _, i, _ in held], None], [ends, None], [zstandard.ZstdCompressor(3).compress(buffer), None], [None, anchors], [None, asked])
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.binary(), _SENT_TYPE)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["chunk", "part", "docs", "ids", "ends", "text", "anchors", "sent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc, doc_id, text in zip(*batch.columns, strict=True):
                held.append((doc.as_py(), doc_id.as_py(), text.as_py() or b""))
                size += len(held[-1][2])
                if size >= chunk_bytes:
                    yield emit(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield emit(number, held)

    return run


# --- pieces -------------------------------------------------------------------------------------------------------------------


def _candidates(data: np.ndarray, ends: np.ndarray, anchors: Arrays, got: dict[int, Arrays]) -> tuple[np.ndarray, np.ndarray]:
    """(candidate windows, breaks) as masks of window starts. A window whose anchor one document has alone is not repeated elsewhere."""
    total, at = max(0, len(data) - WINDOW + 1), np.cumsum(anchors["gaps"], dtype=np.int64)
    h, edges = np.empty(len(at), np.uint64), np.searchsorted(at, np.arange(0, len(data) + BLOCK, BLOCK))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b > a:
            h[a:b] = _hashes(data[k * BLOCK : (k + 1) * BLOCK + GRAM - 1], GRAM)[at[a:b] - k * BLOCK]
    _, key, first = _numbered(h)
    several = np.unpackbits(anchors["several"], count=len(first)).astype(bool)
    dealt, bounds = _anchor_buckets(h[first], int(anchors["buckets"][0]))
    for bucket, reply in got.items():
        own = dealt[bounds[bucket] : bounds[bucket + 1]]
        several[own] |= np.unpackbits(reply["bits"], count=len(own)).astype(bool)
    change = np.zeros(total + 1, np.int32)  # > 0 where a window is whole
    begins = np.concatenate(([0], ends[:-1]))
    long = ends - begins >= WINDOW
    np.add.at(change, begins[long], 1)
    np.add.at(change, ends[long] - WINDOW + 1, -1)
    mask = np.cumsum(change[:total], dtype=np.int32) > 0
    del change
    # Keys are numbered by hash, so the least key of a window's anchors is that of its own anchor.
    least = np.full(total + _SPAN - 1, len(several), np.int32)
    least[at] = key
    mask &= np.append(several, False)[_extreme(least, _SPAN, np.minimum)] if total else mask
    breaks = np.zeros(total, bool)
    cuts = at[h // np.uint64(2) % np.uint64(BREAKS) == 0]
    breaks[cuts[cuts < total]] = True
    return mask, breaks


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows with answers to rows (h, chunk, doc, text, at): the distinct pieces of each chunk and where they occur."""
    for batch in batches:
        for number, docs, ends, text, anchors, got in zip(*batch.columns, strict=True):
            data = zstandard.ZstdDecompressor().decompress(text.as_py())
            docs, ends = docs.values.to_numpy(), ends.values.to_numpy()
            mask, breaks = _candidates(np.frombuffer(data, np.uint8), ends, unpack(anchors.as_py()), received(got.as_py()))
            at = np.flatnonzero(mask & (breaks | ~np.concatenate(([False], mask[:-1]))))
            if not len(at):
                continue
            stop = np.flatnonzero(mask & ~np.concatenate((mask[1:], [False])))  # last windows of the runs
            last = np.minimum(np.append(at[1:], len(mask)) - 1, stop[np.searchsorted(stop, at)])
            owner = np.searchsorted(ends, at, "right")
            seen: dict[bytes, int] = {}
            piece = np.fromiter((seen.setdefault(data[a : b + WINDOW], len(seen)) for a, b in zip(at.tolist(), last.tolist(), strict=True)), np.int64, len(at))
            order = np.argsort(piece, kind="stable")
            doc, offsets = docs[owner[order]], np.concatenate(([0], np.cumsum(np.bincount(piece, minlength=len(seen)))))
            place = (at - np.concatenate(([0], ends))[owner])[order]
            where = pa.StructArray.from_arrays([pa.array(owner[order].astype(np.int32)), pa.array(doc), pa.array(place.astype(np.int32))], ["idx", "doc", "place"])
            columns = [pa.array([xxhash.xxh3_128_digest(p) for p in seen], pa.binary()), pa.array(np.full(len(seen), number.as_py())), pa.array(np.minimum.reduceat(doc, offsets[:-1])), pa.array(list(seen), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), where)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "chunk", "doc", "text", "at"])


# --- suffixes of pieces -------------------------------------------------------------------------------------------------------


class _Texts:
    """Pieces in one buffer: each begins at a multiple of TRIPLE and is followed by zeros, so a place's class is that of its number."""

    def __init__(self, arrays: Arrays):
        self.data, self.start, self.length, self.doc = (arrays[k] for k in ("data", "start", "length", "doc"))

    def words(self, at: np.ndarray) -> np.ndarray:
        """The characters at these places."""
        return np.lib.stride_tricks.sliding_window_view(self.data, WORD)[at].reshape(-1).view(">u8").astype(np.uint64)

    @staticmethod
    def of(texts: list[bytes], docs: list[int]) -> Arrays:
        room = [-(-(len(t) + 3 * TRIPLE) // TRIPLE) * TRIPLE for t in texts]
        start = np.concatenate(([0], np.cumsum(room)[:-1])).astype(np.int64)
        data = b"".join(t.ljust(r, b"\0") for t, r in zip(texts, room, strict=True))
        return {"data": np.frombuffer(data, np.uint8), "start": start, "length": np.array([len(t) for t in texts], np.int64), "doc": np.array(docs, np.int64)}

    def windows(self) -> np.ndarray:
        """The places of all windows of the pieces."""
        n = self.length - WINDOW + 1
        return np.repeat(self.start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))


def _distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, number of each row's key in ascending order, rows with the first of each key)."""
    order = lexicographic(keys)
    fresh = starts_of(keys, order)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order, number, order[fresh]


def _bounds(columns: list[np.ndarray], splitters: list[tuple]) -> np.ndarray:
    """Where each splitter falls among rows in ascending order: rows before it, and so in an earlier bucket."""
    n = len(columns[0])
    row = lambda i: tuple(int(c[i]) for c in columns)
    return np.array([0, *[bisect.bisect_left(range(n), s, key=row) for s in splitters], n])


def _send_rows(keys: list[np.ndarray], first: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> list[dict]:
    """The distinct keys, ascending, by bucket."""
    columns = [k[first] for k in keys]
    parts = zip(labels.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
    return sent([(label, {f"k{i}": c[a:b] if i else gaps(c[a:b]) for i, c in enumerate(columns)}) for label, a, b in parts if b > a])


def _rank(pieces: list[Arrays]) -> list[Arrays]:
    """Ranks of the keys within the bucket, from 0."""
    keys = [np.concatenate([np.cumsum(p["k0"], dtype=np.uint64) for p in pieces])]
    keys += [np.concatenate([p[k] for p in pieces]) for k in ("k1", "k2")]
    _, number, _ = _distinct(keys)
    return [{"rank": gaps(part).astype(np.uint32)} for part in np.split(number, np.cumsum([len(p["k0"]) for p in pieces])[:-1])]


def _names(got: dict[int, Arrays]) -> np.ndarray:
    """Names of the keys that were sent, in ascending order: bucket and rank in one number, from 1 on."""
    return np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(got[b]["rank"], dtype=np.uint64) + np.uint64((b << 32) + 1) for b in sorted(got)]])


def _buckets_of_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, buckets) of ascending names."""
    bucket = (names - np.uint64(1)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return np.append(at, len(bucket)), bucket[at].astype(np.int64)


def _window_hashes(arrays: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(places of all windows, number of each one's hash in ascending order, the distinct hashes, how often each occurs, and the
    bytes before and after it, SEVERAL where they differ or a piece ends)."""
    texts = _Texts(arrays)
    at = texts.windows()
    h = _hashes(texts.data, WINDOW)[at]
    order, number, first = _numbered(h)
    hashes = h[first]
    del h, first
    count = np.bincount(number, minlength=len(hashes)).astype(np.int32)
    starts = np.cumsum(count)
    starts -= count
    length = texts.length - WINDOW + 1
    begins = np.cumsum(length) - length
    sides = []
    for shift, edges in ((-1, begins), (WINDOW, begins + length - 1)):
        side = texts.data[at + shift]
        side[edges[length > 0]] = SEVERAL
        sides.append(_side(side[order], starts))
    return at, number, hashes, count, sides


def _side(side: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The byte that all of each group have, or SEVERAL."""
    if not len(starts):
        return side
    least = np.minimum.reduceat(side, starts)
    return np.where(least == np.maximum.reduceat(side, starts), least, np.uint8(SEVERAL))


def _ask_windows(arrays: Arrays, buckets: int) -> list[dict]:
    _, _, hashes, _, (before, after) = _window_hashes(arrays)
    ranges, bounds = _ranges(buckets), _by_bucket(hashes, buckets).tolist()
    kind = np.uint32 if (1 << HASH_BITS) // buckets < 1 << 32 else np.uint64
    return sent([(k, {"gaps": gaps((hashes[a:b] - ranges[k]).astype(kind)), "before": before[a:b], "after": after[a:b]}) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a])


def _neighbours(pieces: list[Arrays]) -> list[Arrays | None]:
    """Which hashes of each piece other pieces have too, and of those which have one byte only before or after them."""
    h, edges = ascending(pieces)
    sides = {n: np.concatenate([p.pop(n) for p in pieces]) for n in ("before", "after")}
    found = {"bits": np.empty(len(h), bool), "before": np.empty(len(h), bool), "after": np.empty(len(h), bool)}
    for at in shares(h):
        order, fresh = _ordered(h[at])
        order, starts = at[order], np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(at)))
        several = sizes > 1
        found["bits"][order] = np.repeat(several, sizes)
        for name, side in sides.items():
            found[name][order] = np.repeat(several & (_side(side[order], starts) != SEVERAL), sizes)
    return [{n: np.packbits(f[a:b]) for n, f in found.items()} if found["bits"][a:b].any() else None for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _needed(windows: np.ndarray) -> np.ndarray:
    """The sampled suffixes that the order of ``windows`` depends on."""
    kind = windows // WORD % 3
    return np.unique(np.concatenate((windows[kind > 0], windows[kind < 2] + WORD, windows[kind != 1] + 2 * WORD)))


def _triples(texts: _Texts, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places, triples) of the sample as far as ``windows`` depend on it: up to three triples for each suffix."""
    need = _needed(windows)
    at = np.unique(np.concatenate([need, need + TRIPLE, need + 2 * TRIPLE]))
    piece = np.searchsorted(texts.start, at, "right") - 1
    at = at[at < texts.start[piece] + texts.length[piece]]
    return at, [texts.words(at + WORD * k) for k in range(3)]


def _discard(arrays: Arrays, got: dict[int, Arrays], buckets: int) -> Arrays:
    """Leaves the windows that another place of any piece has too and that no other one leads, and how many windows follow each."""
    at, number, hashes, count, sides = _window_hashes(arrays)
    bounds = _by_bucket(hashes, buckets)
    several, (before, after) = count > 1, [s != SEVERAL for s in sides]
    for bucket, reply in got.items():
        a, b = bounds[bucket], bounds[bucket + 1]
        bits, one_before, one_after = (np.unpackbits(reply[n], count=b - a).astype(bool) for n in ("bits", "before", "after"))
        several[a:b] |= bits
        before[a:b] &= ~bits | one_before
        after[a:b] &= ~bits | one_after
    led = before[number]  # never a piece's first window
    led[1:] &= (after & several)[number[:-1]]
    kept = several[number]
    lead = np.flatnonzero(~led[kept])
    return {**arrays, "windows": at[kept][lead], "run": np.diff(np.append(lead, int(kept.sum())))}


def _ask_triples(arrays: Arrays, splitters: list[tuple]) -> list[dict]:
    _, keys = _triples(_Texts(arrays), arrays["windows"])
    _, _, first = _distinct(keys)
    return _send_rows(keys, first, _bounds([k[first] for k in keys], splitters), np.arange(len(splitters) + 1))


def _recurse(state: Arrays, got: dict[int, Arrays]) -> tuple[Arrays, list[dict]]:
    """Asks for the ranks of the suffixes by triples of names."""
    texts, windows = _Texts(state), state["windows"]
    at, triples = _triples(texts, windows)
    _, number, _ = _distinct(triples)
    name = np.zeros(len(texts.data) + 3 * TRIPLE, np.uint64)
    name[at] = _names(got)[number]
    need = _needed(windows)
    keys = [name[need + TRIPLE * k] for k in range(3)]
    _, index, first = _distinct(keys)
    bounds, labels = _buckets_of_names(keys[0][first])
    return {**state, "index": index.astype(np.int32), "own": name[windows]}, _send_rows(keys, first, bounds, labels)


def _prefixes(texts: _Texts, at: np.ndarray) -> dict[str, np.ndarray]:
    """Of WINDOW bytes from each place on the first two words, which merging compares, and a digest of 112 bits, which adjacent
    prefixes are compared by: of N prefixes two different neighbours are confused with a probability below N / 2**112."""
    flat = np.lib.stride_tricks.sliding_window_view(texts.data, WINDOW)[at].reshape(-1)
    first, second = (_hashes(data, WINDOW, bits) if len(at) else np.zeros(0, np.uint64) for data, bits in ((flat, 64), (flat[::-1], DIGEST_BITS)))
    return {"w0": texts.words(at), "w1": texts.words(at + WORD), "p0": first[::WINDOW], "p1": second[::-1][::WINDOW]}


def _dealt(state: Arrays, got: dict[int, Arrays], splitters: list[tuple]) -> tuple[Arrays, np.ndarray, np.ndarray]:
    """The suffixes that are left, those that are equal to the depth of their ranks once, in the order of the buckets of their first triples:
    what they are merged by, their buckets, and which of them each window has."""
    texts, windows = _Texts(state), state["windows"]
    names, need = _names(got), _needed(windows)
    rank = lambda at: names[state["index"][np.minimum(np.searchsorted(need, at), len(need) - 1)]]
    kind = (windows // WORD % 3).astype(np.uint8)
    zero = np.uint64(0)
    own = np.where(kind > 0, rank(windows), zero)
    next1, next2 = np.where(kind < 2, rank(windows + WORD), zero), np.where(kind != 1, rank(windows + 2 * WORD), zero)
    doc = texts.doc[np.searchsorted(texts.start, windows, "right") - 1]
    _, item, first = _distinct([kind, own, np.where(kind == 0, texts.words(windows), zero), np.where(kind == 0, next1, zero)])
    least = np.full(len(first), LAST)
    np.minimum.at(least, item, doc)
    at = windows[first]
    bucket = np.where(kind[first] > 0, (state["own"][first] - np.uint64(1)) >> np.uint64(32), zero).astype(np.int64)
    zeros = np.flatnonzero(kind[first] == 0)
    triples = [texts.words(at[zeros] + WORD * k) for k in range(3)]
    rows = lexicographic(triples)
    bounds = _bounds([t[rows] for t in triples], splitters)
    bucket[zeros[rows]] = np.repeat(np.arange(len(splitters) + 1), np.diff(bounds))
    dealt = np.argsort(bucket, kind="stable")
    position = np.empty(len(dealt), np.int64)
    position[dealt] = np.arange(len(dealt))
    chosen = first[dealt]
    return {"at": windows[chosen], "kind": kind[chosen], "own": own[chosen], "next1": next1[chosen], "next2": next2[chosen], "doc": least[dealt]}, bucket[dealt], position[item]


def _send_suffixes(state: Arrays, got: dict[int, Arrays], splitters: list[tuple]) -> list[dict]:
    if not len(state["windows"]):
        return []
    columns, bucket, _ = _dealt(state, got, splitters)
    columns |= _prefixes(_Texts(state), columns.pop("at"))
    columns["w1"] = np.where(columns["kind"] == 1, np.uint64(0), columns["w1"])  # of no use there
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return sent([(int(bucket[a]), {n: c[a:b] for n, c in columns.items()}) for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True)])


def _before(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of ``b`` come before each of ``a``, and the other way round; ties are cut in favour of ``a``."""
    n = len(a[0])
    order = lexicographic([np.concatenate(x) for x in zip(a, b, strict=True)])
    second = order >= n
    count = np.empty(len(order), np.int64)
    count[order] = np.where(second, np.cumsum(~second), np.cumsum(second))
    return count[:n], count[n:]


def _merge(pieces: list[Arrays]) -> list[Arrays]:
    """Merges the three kinds of suffixes, compares adjacent prefixes, and answers with the least doc of each suffix's class."""
    column = lambda name: np.concatenate([p[name] for p in pieces])
    kind, own, next1, next2, doc = (column(n) for n in ("kind", "own", "next1", "next2", "doc"))
    words = [column("w0"), column("w1")]
    rows = [np.flatnonzero(kind == k) for k in range(3)]
    place = np.zeros(len(kind), np.int64)
    keys01 = lambda r: [words[0][r], next1[r]]
    keys02 = lambda r: [words[0][r], words[1][r], next2[r]]
    for k, keys in ((0, keys01), (1, lambda r: [own[r]]), (2, lambda r: [own[r]])):
        order = lexicographic(keys(rows[k]))
        place[rows[k][order]] += np.arange(len(order))
    for x, y, keys in ((0, 1, keys01), (0, 2, keys02), (1, 2, lambda r: [own[r]])):
        before_x, before_y = _before(keys(rows[x]), keys(rows[y]))
        place[rows[x]] += before_x
        place[rows[y]] += before_y
    order = np.argsort(place, kind="stable")
    fresh = starts_of([column("p0"), column("p1")], order)
    group = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(doc[order], np.flatnonzero(fresh))
    found = np.empty(len(order), np.int64)
    found[order] = least[group]
    parts = np.split(found, np.cumsum([len(p["doc"]) for p in pieces])[:-1])
    return [{"least": p} for p in parts]


def _later(state: Arrays, item: np.ndarray, got: dict[int, Arrays]) -> list[list[dict]]:
    """For each piece the runs [start, stop) of bytes that a window covers which starts in a document before the piece's first."""
    least = np.concatenate([got[b]["least"] for b in sorted(got)]) if got else np.zeros(0, np.int64)
    at = state["windows"]
    piece = np.searchsorted(state["start"], at, "right") - 1
    hit = least[item] < state["doc"][piece] if len(at) else np.zeros(0, bool)
    at, piece, end = at[hit], piece[hit], (at + state["run"])[hit]
    out: list[list[dict]] = [[] for _ in state["start"]]
    if len(at):
        edge = np.flatnonzero(np.concatenate(([True], (at[1:] != end[:-1]) | (piece[1:] != piece[:-1]))))
        for a, b, k in zip(at[edge].tolist(), end[np.append(edge[1:], len(at)) - 1].tolist(), piece[edge].tolist(), strict=True):
            out[k].append({"start": a - int(state["start"][k]), "stop": b - int(state["start"][k]) + WINDOW - 1})
    return out


# --- the rounds ---------------------------------------------------------------------------------------------------------------

_STATE = f"chunk long, part string, hs array<binary>, state binary, sent {SENT}"


def _rows(chunk: int, hs: list[bytes] | None, state: Arrays | None, asked: list[dict] | None) -> pa.RecordBatch:
    """A chunk's state and what it asks, as one row each."""
    found = [] if state is None else [("state", hs, pack(state), None)]
    found += [] if asked is None else [("sent", None, None, asked)]
    part, names, states, sends = zip(*found, strict=True)
    columns = [pa.array([chunk] * len(found), pa.int64()), pa.array(part), pa.array(names, pa.list_(pa.binary())), pa.array(states, pa.binary()), pa.array(sends, _SENT_TYPE)]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "hs", "state", "sent"])


def _piece_chunks(chunk_bytes: int):
    """Rows (h, doc, text) to rows of states."""

    def emit(number: int, held: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        state = _Texts.of([t for _, _, t in held], [d for _, d, _ in held])
        return _rows(number, [h for h, _, _ in held], state, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                held.append(tuple(x.as_py() for x in row))
                size += len(held[-1][2])
                if size >= chunk_bytes:
                    yield emit(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield emit(number, held)

    return run


Step = Callable[[Arrays, dict[int, Arrays]], tuple[Arrays | None, list[dict] | None]]


def _stepped(states: DataFrame, answers: DataFrame | None, step: Step) -> DataFrame:
    """What ``step`` makes of the states and the answers to what they asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hs, state, got in zip(*batch.columns, strict=True):
                yield _rows(chunk.as_py(), hs.as_py(), *step(unpack(state.as_py()), received(got.as_py())))

    rows = states.select("chunk", "hs", "state")
    rows = rows.withColumn("got", F.lit(None).cast(SENT)) if answers is None else rows.join(answers, "chunk", "left")
    return rows.mapInArrow(run, _STATE)


def _round(states: DataFrame, asked: DataFrame | None, compare: Callable[[list[Arrays]], list[Arrays | None]] | None, step: Step, label: str) -> list[DataFrame]:
    """(states, what they ask) after ``step``, as written tables; those of the round before are removed."""
    answers = None if asked is None else answer(asked, compare)
    made = cut_by(_stepped(states, answers, step), "part", label, "state", "sent")
    release(states.sparkSession, states, *([] if asked is None else [asked]))
    return made


def _splitters(states: DataFrame, bucket_keys: int) -> list[tuple]:
    """Triples that part the sample into about equal buckets, from a bounded part of it drawn by hash."""
    chunks = states.count()
    if not chunks:
        return []
    few = states if chunks <= SAMPLED // 8 else states.where(F.pmod(F.xxhash64("chunk"), F.lit(chunks)) < SAMPLED // 8)
    each = max(8, SAMPLED // max(1, chunks))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in batch.column(0):
                arrays = unpack(state.as_py())
                at, keys = _triples(_Texts(arrays), arrays["windows"])
                rows = np.random.default_rng(len(at)).integers(0, len(at), min(len(at), each)) if len(at) else at
                share = pa.array(np.full(len(rows), len(at) / max(1, len(rows))))
                yield pa.RecordBatch.from_arrays([*(pa.array(k[rows].view(np.int64)) for k in keys), share], names=["k0", "k1", "k2", "share"])

    rows = few.select("state").mapInArrow(draw, "k0 long, k1 long, k2 long, share double").toArrow()
    *keys, share = (c.to_numpy() for c in rows.columns)
    buckets = buckets_for(share.sum() * max(1, chunks / (SAMPLED // 8)), bucket_keys)
    drawn = sorted(set(zip(*[k.view(np.uint64).tolist() for k in keys], strict=True)))
    return sorted({drawn[len(drawn) * k // buckets] for k in range(1, buckets)}) if drawn else []


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows (ids, ends, text, spans) to one row a document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    for batch in batches:
        for ids, ends, text, spans in zip(*batch.columns, strict=True):
            data, at, kept = memoryview(zstandard.ZstdDecompressor().decompress(text.as_py())), 0, []
            by_doc: dict[int, list[tuple[int, int]]] = {}
            for s in spans.as_py() or ():
                by_doc.setdefault(s["idx"], []).append((s["start"], s["stop"]))
            for k, end in enumerate(ends.as_py()):
                gone: list[list[int]] = []
                for a, b in sorted(by_doc.get(k, ())):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                sha, own, place = hashlib.sha256(), data[at:end], 0
                for a, b in gone:
                    sha.update(own[place:a])
                    place = b
                sha.update(own[place:])
                kept.append((end - at, sum(b - a for a, b in gone), len(gone), sha.hexdigest(), [{"start": a, "stop": b} for a, b in gone]))
                at = end
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([ids.values, *(pa.array(v, t) for v, t in zip(zip(*kept, strict=True), kinds, strict=True))], names=names)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, piece_bytes: int = PIECE_CHUNK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed), ``removed`` being [start, stop) byte ranges.

    ``doc_id`` is an integer; null ids come after all others. Rows that share an id, null too, remove nothing from each other. A null text is
    an empty one; texts shorter than a window lose nothing; an empty table gives an empty one; only the two columns are read.
    A document, however long, is one chunk's row: it must fit a task. ``docs`` is read once for its rows and once for its size.
    The last three parameters are what tasks hold at a time; they change the cost only.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = widely(size / BYTES_PER_ANCHOR, bucket_keys)
    arrow_kind = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    made = rows.mapInArrow(_chunks(arrow_kind, buckets, chunk_bytes), f"chunk long, part string, docs array<bigint>, ids array<{kind}>, ends array<bigint>, text binary, anchors binary, sent {SENT}")
    chunks, asked = cut_by(made, "part", "text-chunks", "state", "sent")

    named = chunks.select("chunk", "docs", "ends", "text").join(asked.select("chunk", "anchors"), "chunk").join(answer(asked, _repeated), "chunk", "left")
    pieces = cut(named.mapInArrow(_pieces, "h binary, chunk long, doc long, text binary, at array<struct<idx:int,doc:bigint,place:int>>"), "pieces")
    release(spark, asked)

    few = widely(pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0, bucket_keys)
    distinct = pieces.groupBy("h").agg(F.min("doc").alias("doc"), F.first("text").alias("text")).select("h", "doc", "text")
    pieced = cut(distinct.mapInArrow(_piece_chunks(piece_bytes), _STATE), "piece-chunks")
    release(spark)
    # What is asked of windows goes to its buckets without being written first.
    answers = answer(_stepped(pieced, None, lambda a, _: (None, _ask_windows(a, few))), _neighbours)
    states = cut(_stepped(pieced, answers, lambda a, g: (_discard(a, g, few), None)), "windows")
    release(spark, pieced)
    splitters = _splitters(states, bucket_keys)
    states, asked = _round(states, None, None, lambda a, _: (a, _ask_triples(a, splitters)), "triples")
    states, asked = _round(states, asked, _rank, _recurse, "names")
    ranks = cut(answer(asked, _rank), "ranks")
    release(spark, asked)

    # What is sent to be merged goes to its buckets without being written first, so both sides of the merge derive it from the ranks.
    merged = answer(_stepped(states, ranks, lambda a, g: (None, _send_suffixes(a, g, splitters))), _merge)
    ends = states.select("chunk", "hs", "state").join(ranks.withColumnRenamed("got", "ranks"), "chunk", "left").join(merged, "chunk", "left")
    runs = cut(ends.mapInArrow(_runs(splitters), "h binary, first long, runs array<struct<start:int,stop:int>>"), "runs")
    release(spark, states, ranks)

    # Where a piece lies in a later document than its first, all of it goes; in the first one what a window of another piece covers.
    def spans(o):
        whole = F.array(F.struct(o["idx"].alias("idx"), o["place"].alias("start"), (o["place"] + F.col("size")).alias("stop")))
        part = F.transform("runs", lambda r: F.struct(o["idx"].alias("idx"), (o["place"] + r["start"]).alias("start"), (o["place"] + r["stop"]).alias("stop")))
        return F.when(o["doc"] > F.col("first"), whole).otherwise(part)

    found = pieces.select("h", "chunk", F.octet_length("text").alias("size"), "at").join(runs, "h").select("chunk", F.flatten(F.transform("at", spans)).alias("spans"))
    gone = cut(found.where(F.size("spans") > 0).groupBy("chunk").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    release(spark, pieces, runs)
    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:bigint,stop:bigint>>"
    return chunks.select("chunk", "ids", "ends", "text").join(gone, "chunk", "left").select("ids", "ends", "text", "spans").mapInArrow(_outputs, out)


def _runs(splitters: list[tuple]):
    """States with ranks and what merging answered to rows (h, first, runs) of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hs, state, ranks, got in zip(*batch.columns, strict=True):
                arrays = unpack(state.as_py())
                item = _dealt(arrays, received(ranks.as_py()), splitters)[2] if len(arrays["windows"]) else np.zeros(0, np.int64)
                runs = pa.array(_later(arrays, item, received(got.as_py())), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                yield pa.RecordBatch.from_arrays([hs.values, pa.array(arrays["doc"]), runs], names=["h", "first", "runs"])

    return run
