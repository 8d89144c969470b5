import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from lexframe.llm import sketch, substring

from .inputs import awkward, frame


def plain(rows):
    """Judged window by window in the order of (doc_id, place)."""
    docs = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0])
    seen, out = set(), {}
    for doc, text in docs:
        ws, gone = (text or "").encode().split(), set()
        for i in range(len(ws) - 19):
            window = tuple(ws[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        out[doc] = (len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest())
    return out


def digest(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("cells, chunk", [(sketch.CELLS_PER_HASH, substring.CHUNK), (0.2, 100), (30.0, 2000)])
def test_against_plain(spark, monkeypatch, cells, chunk):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    monkeypatch.setattr(substring, "SLICE_BYTES", 2000)
    rng = random.Random(8)
    passages = [" ".join(f"p{rng.randrange(50)}" for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(9)}" for _ in range(rng.randrange(40))) for _ in range(4)]
        rows.append((i, " ".join(parts), None, None, None, None, None, None))
    rows.append((99, "ab " * 70, None, None, None, None, None, None))
    df = frame(spark, rows).repartition(5)
    assert digest(substring.repeated_passages(df, cells=cells)) == plain(rows)


def test_awkward_rows(spark):
    rows = [r for r in awkward() if r[0] is not None]
    found = substring.repeated_passages(frame(spark, rows)).collect()
    assert len(found) == len(rows) and {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == plain(rows)
    with_nulls = substring.repeated_passages(frame(spark)).collect()
    assert len(with_nulls) == len(awkward()) and [r["n_removed"] for r in with_nulls if r["doc_id"] is None and r["n_words"] > 1] == [60]


def test_same_id_other_text(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(5, text, None, None, None, None, None, None), (5, "y " + text, None, None, None, None, None, None), (6, text, None, None, None, None, None, None)]
    removed = sorted((r["n_words"], r["n_removed"]) for r in substring.repeated_passages(frame(spark, rows)).collect())
    assert removed in ([(30, 0), (30, 30), (31, 30)], [(30, 30), (30, 30), (31, 0)])


def test_empty(spark):
    assert substring.repeated_passages(frame(spark, [])).count() == 0
    assert substring.repeated_passages(frame(spark, [(1, None, None, None, None, None, None, None)])).first()["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_windows_are_polynomials_and_cells_pack():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 57, dtype=np.uint64)
    rolled = substring._roll(base, substring._M1, 20)
    m = int(substring._M1)
    expected = [sum(int(base[i + j]) * pow(m, 19 - j, 1 << 64) for j in range(20)) % (1 << 64) for i in range(38)]
    assert rolled.tolist() == expected
    cells = np.unique(rng.integers(0, 1 << 22, 5000)).astype(np.uint32)
    assert (sketch._unpack(sketch._pack(cells)) == cells).all() and not len(sketch._unpack(sketch._pack(cells[:0])))


def test_anchors_against_plain():
    rng = random.Random(3)
    texts = [[str(rng.randrange(k)).encode() for _ in range(n)] for k, n in ((3, 90), (1, 50), (9, 20), (9, 19), (500, 70), (2, 0))]
    found = substring.Windows(texts)
    grams = substring._finish(substring._roll(found.base, substring._M1, substring.GRAM))
    at, anchors, least = 0, [], []
    for number, words in enumerate(texts):
        places = set()
        for start in range(at, at + len(words) - 19):
            own = grams[start : start + 13]
            least.append((number, start - at, int(own.min())))
            places |= {start + i for i in np.flatnonzero(own == own.min()).tolist()}
        anchors += [(number, int(grams[p])) for p in sorted(places)]
        at += len(words)
    assert list(zip(found.anchor_owner.tolist(), found.anchors.tolist(), strict=True)) == anchors
    assert list(zip(found.owner.tolist(), found.place.tolist(), found.least.tolist(), strict=True)) == least


@pytest.mark.parametrize("size", [3_000, 600_000])
def test_pass_rate_does_not_grow_with_the_input(spark, size):
    rng = np.random.default_rng(size)
    once = rng.integers(-(1 << 63), (1 << 63) - 1, size, dtype=np.int64)
    rows = spark.createDataFrame(pd.DataFrame({"h": np.concatenate((once, once[:50], once[:50]))})).repartition(3)
    bits = sketch.bits_for(size)

    def hashes(batches):
        for batch in batches:
            yield batch.column(0).to_numpy().view(np.uint64)

    passed = {r[0] for r in sketch.estimated_repeated(rows, "h", sketch.repeated_cells(rows, hashes, bits), bits).distinct().collect()}
    assert set(once[:50].tolist()) <= passed
    assert (len(passed) - 50) / size < 0.005
