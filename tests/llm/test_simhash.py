import random

import numpy as np
import pytest
import xxhash

from lexframe.llm import graph, resemblance, simhash

from .inputs import awkward, frame


def plain(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """doc_id -> least doc_id reachable, by comparing all pairs."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {i: root(i) for i in ids}


def test_awkward_rows(spark):
    rows = simhash.near_duplicates(frame(spark)).collect()
    assert len(rows) == len(awkward())
    prints = {r[0]: plain(r[1]) for r in awkward() if r[0] is not None}
    expected = components(prints)
    for r in rows:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == expected[r["doc_id"]]
    nulls = {r["fingerprint"]: r["component_id"] for r in rows if r["doc_id"] is None}
    assert nulls[f"{plain(awkward()[11][1]):016x}"] == 11 and nulls[f"{plain('nadie'):016x}"] is None


@pytest.mark.parametrize("levels, shard_rows", [(12, 64), (2, 16)])
def test_shards_find_every_pair(spark, monkeypatch, levels, shard_rows):
    """Planted chains of fingerprints one and two bits apart, over many shards, with one tree and with trees below it."""
    monkeypatch.setattr(simhash, "LEVELS", levels)
    monkeypatch.setattr(simhash, "ROUTED_ROWS", 100)
    rng = random.Random(3)
    prints = {}
    for start in range(0, 1200, 6):
        value = rng.getrandbits(64) if start % 60 else 0xFFFF
        for k in range(6):
            prints[start + k] = value
            for _ in range(rng.choice((1, 2, 2, 3))):
                value ^= 1 << rng.randrange(64)
    signed = {int(np.uint64(p).astype(np.int64)): p for p in prints.values()}
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    parted = []
    monkeypatch.setattr(simhash, "_part_again", lambda *a, real=simhash._part_again: parted.append(1) or real(*a))
    found = {r["node"]: r["component"] for r in graph.connected_components(simhash.links(df, 2, shard_rows)).collect()}
    expected = components(signed)
    assert {i: found.get(i, i) for i in expected} == expected and len(found) > 300
    assert bool(parted) == (levels == 2)


def test_one_id_with_two_texts(spark):
    """Each text is a document of its own when rows go; the query names one component an id."""
    a, b, c = ("uno dos tres cuatro", "casa perro gato sol luna", "nada que ver con lo otro de antes")
    rows = [(i, t, None, None, None, None, None, None) for i, t in ((3, a), (5, a), (5, b), (9, c), (9, c), (None, a), (None, b), (None, "solo yo"), (None, "solo yo"))]
    docs = frame(spark, rows)
    for drop in (simhash.drop_near_duplicates, resemblance.drop_near_duplicates):
        kept = sorted(((r["doc_id"], r["text"]) for r in drop(docs).collect()), key=str)
        assert kept == sorted([(3, a), (5, b), (9, c), (None, "solo yo")], key=str)
    for find in (simhash.near_duplicates, resemblance.near_duplicates):
        named = sorted((str(r["doc_id"]), str(r["component_id"])) for r in find(docs).collect())
        assert named == sorted([("3", "3"), ("5", "3"), ("5", "3"), ("9", "9"), ("9", "9"), ("None", "3"), ("None", "3"), ("None", "None"), ("None", "None")])


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    found = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_drop_keeps_one_and_all_columns(spark):
    docs = frame(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = {r[0]: plain(r[1]) for r in awkward() if r[0] is not None}
    expected = components(prints)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(expected.values())) and ids.count(None) == 1


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.drop_near_duplicates(frame(spark, [])).count() == 0
