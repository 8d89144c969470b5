import hashlib
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lexframe.llm import common, exchange, suffixes

from .inputs import awkward, frame

W = suffixes.WINDOW


def plain(rows):
    """The contract on (doc_id, text) rows, window by window."""
    last = 2**63 - 1
    docs = [(i, last if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for _, d, t in docs:
        for k in range(len(t) - W + 1):
            s = t[k : k + W]
            least[s] = min(least.get(s, last), d)
    out = []
    for i, d, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - W + 1):
            if least[t[k : k + W]] < d:
                gone[k : k + W] = b"\x01" * W
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def material(seed, n=150):
    """Shared passages at any offset, near copies, copies, runs of one byte, NUL bytes, periodic texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(20) for _ in range(6)] + ["x" * 400, "ab" * 150, "\0" * 120, "abc\0" * 60, prose(15)[:W], prose(15)[: W + 1]]
    rows, texts = [], []
    for _ in range(n):
        text = prose(rng.randrange(40)) + rng.choice(passages) * rng.randrange(2) + prose(rng.randrange(30))
        if texts and rng.random() < 0.3:
            text = list(rng.choice(texts))
            for _ in range(rng.randrange(3)):
                text[rng.randrange(max(1, len(text))) : 1] = "#"
            text = "".join(text)
        texts.append(text)
        rows.append((rng.choice([None, rng.randrange(n)]) if rng.random() < 0.2 else 1000 + len(rows), text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_whole_results_against_plain(spark, seed):
    """Small chunks and buckets, so that classes lie in many of them."""
    rows = material(seed)
    sizes = {"chunk_bytes": 3000, "piece_bytes": 2000, "bucket_keys": 1500} if seed > 1 else {}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(suffixes.repeated_bytes(docs, **sizes)) == plain(rows)


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choice(b"ab ") for _ in range(5000)), np.uint8)
    ends = np.array([30, 30, 1200, 5000])
    whole = suffixes._anchors(data, ends)
    monkeypatch.setattr(suffixes, "BLOCK", 701)
    assert all((a == b).all() for a, b in zip(whole, suffixes._anchors(data, ends), strict=True))


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    assert found(suffixes.repeated_bytes(frame(spark))) == plain(rows)
    assert suffixes.repeated_bytes(frame(spark, [])).collect() == []
    clash = frame(spark).selectExpr("doc_id as chunk", "text as spans", "1 as doc_id", "'q' as text", "2 as h", "n_chars as ids")
    assert found(suffixes.repeated_bytes(clash, "chunk", "spans")) == plain(rows)


def test_removed_ranges_are_the_removed_bytes(spark):
    rows = material(7, 60)
    texts = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    by_id = {k: t.encode() for k, (_, t) in enumerate(rows)}
    for r in suffixes.repeated_bytes(texts).collect():
        kept, at = b"", 0
        for s in r["removed"]:
            assert s["start"] >= at and s["stop"] - s["start"] >= W
            kept, at = kept + by_id[r["doc_id"]][at : s["start"]], s["stop"]
        assert hashlib.sha256(kept + by_id[r["doc_id"]][at:]).hexdigest() == r["kept_sha256"]


def test_merge_is_a_sort_by_prefixes():
    """Suffixes of all three kinds, ranked by themselves, come out in classes of equal prefixes."""
    rng = np.random.default_rng(5)
    base = bytes(rng.integers(97, 99, 4000, np.uint8))
    texts = suffixes._Texts(suffixes._Texts.of([base[:2000], base[1000:3000], base[500:2500]], [3, 2, 1]))
    at = texts.windows()
    suffix = [bytes(texts.data[p : p + 120]) for p in at]
    rank = {s: k for k, s in enumerate(sorted({bytes(texts.data[p : p + 100]) for p in range(len(texts.data) - 100)}))}
    deep = lambda p: rank[bytes(texts.data[p : p + 100])]
    kind = at // 8 % 3
    column = lambda f: np.array([f(int(p)) for p in at], np.uint64)
    piece = {"kind": kind.astype(np.uint8), "own": column(deep), "next1": column(lambda p: deep(p + 8)), "next2": column(lambda p: deep(p + 16)), "doc": texts.doc[np.searchsorted(texts.start, at, "right") - 1]}
    piece |= suffixes._prefixes(texts, at)
    got = suffixes._merge([piece])[0]["least"]
    least = {}
    for s, d in zip(suffix, piece["doc"].tolist(), strict=True):
        least[s[:W]] = min(least.get(s[:W], 9), d)
    assert got.tolist() == [least[s[:W]] for s in suffix]


def test_equal_keys_are_sent_once():
    """A passage that fills a chunk makes a few keys, not one for each place."""
    arrays = suffixes._Texts.of([b"abcdefgh" * 5000] * 5, [1, 2, 3, 4, 5])
    asked = suffixes._ask_windows(arrays, 1)
    assert len(exchange.unpack(asked[0]["data"])["gaps"]) == 8
    asked = suffixes._ask_triples({**arrays, "windows": suffixes._Texts(arrays).windows()}, [])
    assert len(exchange.unpack(asked[0]["data"])["k0"]) < 40


def test_of_a_repeated_run_one_window_is_sorted():
    """The windows of a passage that occur in the same pieces follow the first of them, in one chunk and over several."""
    rng = np.random.default_rng(8)
    letters = lambda k, a=97: bytes(rng.integers(a, a + 26, k, np.uint8))
    passage = letters(600)
    texts = [b"<" + letters(80, 65) + passage + letters(90, 65), b">" + letters(30, 65) + passage + b"." + letters(40, 65), letters(60, 65) + b"," + passage[200:300] + b";" + letters(60, 65)]
    whole = suffixes._discard(suffixes._Texts.of(texts, [3, 2, 1]), {}, 1)
    runs = lambda state: sorted(zip((state["windows"] - state["start"][np.searchsorted(state["start"], state["windows"], "right") - 1]).tolist(), state["run"].tolist(), strict=True))
    assert runs(whole) == sorted([(81, 200), (281, 51), (332, 300), (31, 200), (231, 51), (282, 300), (61, 51)])
    chunks = [suffixes._Texts.of([t], [d]) for t, d in zip(texts, [3, 2, 1], strict=True)]
    answers = suffixes._neighbours([exchange.unpack(suffixes._ask_windows(c, 1)[0]["data"]) for c in chunks])
    assert sorted(r for c, a in zip(chunks, answers, strict=True) for r in runs(suffixes._discard(c, {0: a}, 1))) == runs(whole)


def test_buckets_of_anchors_are_about_equal(spark):
    """Anchors are least hashes: among equal ranges of hashes the first has many times the keys of the average one, and a task holds a bucket."""
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(20_000))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "doc as doc_id", "cast(text as binary) as text").repartition(1)
    schema = f"chunk long, part string, docs array<bigint>, ids array<bigint>, ends array<bigint>, text binary, anchors binary, sent {exchange.SENT}"
    rows = docs.mapInArrow(suffixes._chunks(pa.int64(), 24, 10**6), schema).where("part = 'sent'").collect()
    sizes = [len(exchange.unpack(s["data"])["gaps"]) for r in rows for s in r["sent"]]
    assert len(rows) == 1 and len(sizes) == 24 and max(sizes) < 1.3 * sum(sizes) / 24


def test_packed_numbers_take_about_their_entropy():
    rng = np.random.default_rng(6)
    arrays = {"gaps": exchange.gaps(np.sort(rng.integers(0, 1 << 40, 200_000).astype(np.uint64)))}
    arrays |= {"signed": np.array([-1, 5]), "large": np.array([2**64 - 1, 0], np.uint64), "zeros": np.zeros(3, np.int32), "none": np.zeros(0, np.int64), "every": np.arange(9)[::3], "bits": np.array([True, False])}
    data = exchange.pack(arrays)
    assert len(data) < 3.2 * 200_000  # whole numbers took 3.41 bytes each
    found = exchange.unpack(data)
    assert list(found) == list(arrays)
    assert all(found[n].dtype == a.dtype and found[n].flags.writeable and (found[n] == a).all() and len(found[n]) == len(a) for n, a in arrays.items())


def test_release_drops_the_last_shuffle(spark):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(k).getName() for k in range(held.size())}

    before = files()
    table = common.cut(spark.range(100_000).selectExpr("id", "uuid() AS u").repartition(3, "u"), "released")
    made = files() - before
    assert made
    common.release(spark, table)
    end = time.time() + 5
    while files() & made and time.time() < end:
        time.sleep(0.1)
    assert not files() & made


def test_large_buckets_are_compared_by_shares(monkeypatch):
    """Many buckets are larger ones, so that pieces do not follow the square of the input; what comparing takes besides is bounded by a share."""
    rng = np.random.default_rng(9)
    drawn = [np.unique(rng.integers(0, 9000, 4000).astype(np.uint64) << np.uint64(1) | np.uint64(1)) for _ in range(3)]
    sides = [{n: rng.integers(97, 99, len(h)).astype(np.uint8) for n in ("before", "after")} for h in drawn]
    pieces = lambda: [{"gaps": exchange.gaps(h), **s} for h, s in zip(drawn, sides, strict=True)]
    whole = [suffixes._repeated(pieces()), suffixes._neighbours(pieces())]
    sizes = []

    def counted(keys):
        for at in exchange.shares(keys, 500):
            sizes.append(len(at))
            yield at

    monkeypatch.setattr(suffixes, "shares", counted)
    for reply, parted in zip(whole, [suffixes._repeated(pieces()), suffixes._neighbours(pieces())], strict=True):
        assert all((a[n] == b[n]).all() for a, b in zip(reply, parted, strict=True) for n in a)
    assert len(sizes) > 20 and max(sizes) < 1000 and sum(sizes) == 2 * sum(map(len, drawn))
    every = 10 * exchange.BUCKET_KEYS
    assert exchange.widely(every) == 10 and exchange.widely(100 * every) == 250 and exchange.shares(np.zeros(0, np.uint64)).__next__().size == 0


def test_small_pieces_cost_little(spark, monkeypatch):
    """A piece of a few keys makes no compressor of its own and takes little besides its keys; replies of many pieces come back whole."""
    made = []
    for kind in ("ZstdCompressor", "ZstdDecompressor"):
        monkeypatch.setattr(exchange.zstandard, kind, lambda *a, kind=kind, real=getattr(exchange.zstandard, kind): made.append(kind) or real(*a))
    rng = np.random.default_rng(10)
    piece = {"gaps": exchange.gaps(np.sort(rng.integers(0, 1 << 30, 40).astype(np.uint64))).astype(np.uint32), "before": np.zeros(40, np.uint8), "after": np.zeros(40, np.uint8)}
    data = exchange.pack(piece)
    assert all((exchange.unpack(data)[n] == a).all() for n, a in piece.items()) and not made
    assert len(data) < 40 * 4 + 100
    rows = spark.createDataFrame([(c, [{"bucket": b, "data": bytearray(data)} for b in range(7)]) for c in range(50)], f"chunk long, sent {exchange.SENT}").repartition(1)
    got = exchange.answer(rows, lambda pieces: [{"n": np.array([len(p["gaps"])])} for p in pieces])
    assert sorted((r["chunk"], sorted((b, int(a["n"][0])) for b, a in exchange.received([x.asDict() for x in r["got"]]).items())) for r in got.collect()) == [(c, [(b, 40) for b in range(7)]) for c in range(50)]


def test_windows_of_a_chunk_take_bounded_memory():
    """A task holds a chunk's windows: besides their places a few numbers for each."""
    rng = np.random.default_rng(11)
    arrays = suffixes._Texts.of([bytes(rng.integers(97, 123, 500_000, np.uint8))], [1])
    tracemalloc.start()
    suffixes._window_hashes(arrays)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 62 * 500_000
