"""Columns with the names of internal ones come back as they went in."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexframe.llm import decontam, mixing, resemblance, sharding, simhash, toxicity

from .test_classifiers import corpus

NAMES = ["key", "cell", "rank", "row", "id", "raw", "hash", "label", "n", "source_key", "from", "to", "first", "block_", "room", "left", "passes", "blocks", "t", "fp", "root", "node", "h1", "h2", "whole", "epoch", "order_key", "place"]
NAMES += [f"__{n}" for n in ("key", "block", "cell", "id", "raw", "row", "rank", "source", "left", "label")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(d[0], d[1], f"s{d[0] % 3}") for d in corpus(120)[0]] + [(500, corpus(120)[0][3][1], "s0")], "doc_id long, text string, source string")
    return rows.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in NAMES]).cache()


def kept(docs, out):
    before = {r["doc_id"]: r for r in docs.collect()}
    rows = out.collect()
    assert rows and all(r[c] == before[r["doc_id"]][c] for r in rows for c in docs.columns)
    return rows


def test_operators(spark, docs):
    assert len(kept(docs, sharding.shard_rows(docs, 5))) == 121
    assert len(kept(docs, mixing.mix(docs, max_repetition=2.0, block_rows=16))) == 121
    kept(docs, mixing.realise(docs, max_repetition=2.0))
    assert len(kept(docs, simhash.drop_near_duplicates(docs))) < 121
    assert len(kept(docs, resemblance.drop_near_duplicates(docs))) == 120
    kept(docs, decontam.drop_contaminated(docs, spark.createDataFrame([(1, corpus(120)[0][5][1])], "item_id long, text string")))
    labels = spark.createDataFrame(corpus(120)[1], "doc_id long, quality int, toxic int")
    kept(docs, toxicity.drop_toxic(docs, toxicity.train(docs, labels)))


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(corpus(120)[1], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, corpus(120)[0][5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard", "slot"]
    kept(docs, out)
