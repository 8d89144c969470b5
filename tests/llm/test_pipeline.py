"""The pipeline against a plain run of its stages over collected rows."""

from collections import Counter

import pytest

import corpus_pipeline
from lexframe.llm import toxicity

from .inputs import SCHEMA
from .test_classifiers import corpus
from .test_decontam import plain as contamination
from .test_resemblance import groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    docs, labels = corpus(300)
    near = [(1000 + i, d[1] + (" fin" if i % 2 else ""), *d[2:]) for i, d in enumerate(docs[:20])]
    rows = [(*d[:3], f"s{d[0] % 3 if d[0] % 5 else 0}", *d[4:]) for d in [*docs, *near, (2000, None, "en", "s", 0, "x", 0.1, 1), (2001, "", "en", "s", 0, "x", 0.1, 1)]]
    # One id with two texts, of which one is a copy; ids that are null, with a copy and with a text of their own; a repeated row.
    rows += [(250, docs[7][1], "en", "s1", 0, "x", 0.1, 1), (None, docs[8][1], None, None, None, "x", None, None), (None, "solo aqui y en ninguna otra parte", None, None, None, "x", None, None), rows[30]]
    spark.createDataFrame(rows, SCHEMA).drop("shard").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    items = [(1, " ".join(docs[50][1].split()[:15])), (2, "nada que ver con esto")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, items


def test_against_plain(spark, folder):
    root_dir, rows, items = folder
    docs = spark.read.parquet(f"{root_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{root_dir}/labels.parquet"))
    scores = toxicity.Scores(model.lexicon)
    clean = [r for r in rows if model.score(model.passages(toxicity.tokens_of(r[1]), scores)) < toxicity.THRESHOLD]
    assert 0 < len(rows) - len(clean) < 120
    named = groups([(i, r[1]) for i, r in enumerate(clean)])
    members = {}
    for i, root in named.items():
        members.setdefault(root, []).append(clean[i])
    single = [min(m, key=lambda r: (r[0] is None, r[0] or 0)) for m in members.values()]
    assert len(single) < len(clean) - 10
    expected = [r for r in single if not contamination(r[1], items)[4]]
    assert len(expected) < len(single)

    out = corpus_pipeline.run(spark, root_dir)
    found = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"]
    used = Counter((r["doc_id"], r["text"]) for r in found)
    assert set(used) == {(r[0], r[1]) for r in expected} and set(used.values()) == {1, 2}
    # Mixing: of a source all documents are used once, and as many twice as its weight asks for, none of the largest source.
    by_source = {}
    for r in expected:
        by_source.setdefault(r[3], []).append(used[r[0], r[1]])
    size = {k: sum(len((r[1] or "").split()) for r in expected if r[3] == k) for k in by_source}
    assert set(by_source[max(size, key=size.get)]) == {1} and max(sum(v) / len(v) for v in by_source.values()) > 1.8
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len({(r["shard"], r["slot"]) for r in found}) == len(found)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, folder):
    root, rows, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, root)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= 2 * len(rows)
