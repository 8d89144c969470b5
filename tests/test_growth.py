"""What grows with the tables, and what must not."""

import math
import random
from collections import Counter
from pathlib import Path

import pytest

from lexframe import queries
from lexframe.operators import dense, lexical

DATA = Path("/root/testdata/sf0.001")
with_data = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@with_data
def test_a_scope_does_not_copy_the_ids_of_its_norm_to_every_block(spark):
    found = plan(queries.scope_range_plus_extras(spark, str(DATA)))
    assert "collect_set" not in found and "Window" not in found


@with_data
@pytest.mark.parametrize("name", ["bm25_topk", "top_labels"])
def test_pairs_of_query_and_text_are_not_shuffled(spark, name):
    found = plan(queries.QUERIES[name](spark, str(DATA)))
    assert "Exchange hashpartitioning(item_id" in found
    assert not any("doc_id" in line and "item_id" in line for line in found.split("\n") if "Exchange hashpartitioning" in line)


def by_hand(texts, asked, k):
    counts = [(i, Counter(t.split())) for i, t in texts]
    df, n = Counter(w for _, c in counts for w in c), len(texts)
    average = sum(c.total() for _, c in counts) / n
    out = []
    for q, words in asked:
        scored = []
        for i, c in counts:
            parts = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / average)) for w in sorted(set(words.split())) if c[w]]
            scored += [(-math.floor(sum(parts) * 1e6 + 0.5) / 1e6, i)] if parts else []
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_search_is_whole_over_blocks_tiles_and_ties(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical, "ASKED_SENT", 20)
        monkeypatch.setattr(lexical, "SCORES", 60)
    draw = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bcd" for b in "fgh" for c in "klm"]
    texts = [(i, " ".join(draw.choices(words, range(1, 28), k=draw.randrange(9)))) for i in range(150)]
    texts += [(i + 1000, t) for i, t in texts[:60]]  # copies tie
    asked = [(q, " ".join(draw.choices(words, k=4))) for q in range(30)] + [(99, "zzz"), (98, "")]
    found = lexical.search(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, query string"), 7)
    rows = sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in found.collect())
    assert [r[:2] + r[3:] for r in rows] == [r[:2] + r[3:] for r in by_hand(texts, asked, 7)]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(rows, by_hand(texts, asked, 7)))


def test_rows_of_one_id_count_together(spark):
    texts = spark.createDataFrame([(1, "foca luna"), (1, "foca luna"), (2, "foca"), (3, None)], "doc_id long, text string")
    found = lexical.search(texts, spark.createDataFrame([(7, "foca luna")], "query_id long, query string"), 5).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2]
    assert lexical.postings(texts, "doc_id", "text").where("doc_id = 1 and term = 'foca'").first()["tf"] == 2


def test_a_task_gives_k_vectors_for_a_query_whatever_its_batches(spark, monkeypatch):
    draw = random.Random(5)
    vectors = spark.createDataFrame([(i, [float(draw.randrange(1, 4)) for _ in range(3)]) for i in range(100)], "vec_id long, embedding array<float>").coalesce(1)
    queries = vectors.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    whole = sorted(map(tuple, dense.search(vectors, queries, 4).collect()))
    monkeypatch.setattr(dense, "SCORES", 30)  # tiles of three queries by ten vectors
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        assert sorted(map(tuple, dense.search(vectors, queries, 4).collect())) == whole and len(whole) == 40
        monkeypatch.setattr(dense, "top_k", lambda found, *_: found)
        assert dense.search(vectors, queries, 4).count() == 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@with_data
def test_sparse_vectors_shuffle_terms_once(spark):
    found = plan(queries.sparse_vectors(spark, str(DATA)))
    assert found.count("Exchange ") == 1 and "MapInArrow" in found
