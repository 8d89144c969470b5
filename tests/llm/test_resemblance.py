import random

import corpus_pipeline
from lexframe.llm import resemblance

from .inputs import awkward, frame, words


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def groups(rows):
    """doc_id -> least doc_id reachable, by comparing the sets of all pairs."""
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {i: root(i) for i in sets}


def edited():
    """Texts with up to five words changed, chains of edits, one line that most share, and a large group of near copies."""
    rng = random.Random(11)
    line, rows = " ".join(words(rng, 30, 5000)), []
    for at in range(0, 600, 6):
        text = words(rng, rng.randrange(20, 160), 5000)
        for k in range(6):
            rows.append((at + k, " ".join(text) + (" " + line if at % 12 else "")))
            for _ in range(rng.choice((1, 1, 2, 5))):
                text[rng.randrange(len(text))] = f"z{rng.randrange(9999)}"
    base = words(rng, 100, 5000)
    for i in range(150):
        rows.append((1000 + i, " ".join([*base[:90], f"n{i}", *base[90:]])))
    rng.shuffle(rows)
    return [(i, t, "en", "s", 0, "x", 0.5, 1) for i, t in rows]


def test_every_pair_is_found(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "SAMPLE", 2)
    monkeypatch.setattr(resemblance, "LEADERS", (2, 5, None))
    rows = edited()
    expected = groups(rows)
    found = {r["doc_id"]: r["component_id"] for r in resemblance.near_duplicates(frame(spark, rows).repartition(3)).collect()}
    assert found == expected and 300 < sum(i != c for i, c in expected.items())


def test_awkward_rows(spark):
    found = resemblance.near_duplicates(frame(spark)).collect()
    assert len(found) == len(awkward())
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == groups(awkward())
    assert sorted(str(r["component_id"]) for r in found if r["doc_id"] is None) == ["11", "None"]
    assert resemblance.near_duplicates(frame(spark, [])).count() == 0


def test_stage_drops_what_is_alike(spark):
    rows = edited()
    kept = corpus_pipeline.without_near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups(rows).values()))
