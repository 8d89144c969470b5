"""Documents to a mixed, sharded training corpus: each stage's rows are written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexframe.llm import decontam, mixing, resemblance, sharding, toxicity
from lexframe.llm.common import cut

SHARDS = 40
MAX_REPETITION = 2.0


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts hold no passage and stay; rows that repeat an id are
    judged each; without labels all stay."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a Jaccard similarity of five-word shingles of 0.8 the smallest doc_id stays: operator 1
    by its fingerprints, confirmed on whole sets, and an exact join for the pairs that fingerprints cannot tell. Null and blank
    texts are one group; each text of a repeated id is a document of its own; null ids go only if another of their group stays."""
    return resemblance.drop_near_duplicates(docs, shingle=5, similarity=0.8, reach=2)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go. Null and wordless texts stay, null items match nothing."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, at most twice over; every document is used at least once, those without words too. A null
    source is a source of its own."""
    return mixing.realise(docs, max_repetition=MAX_REPETITION)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot; counts of shards are at most one apart, whatever is null or repeated."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("temperature_mixing", mixed),
    ("bounded_load_sharding", sharded),
]

#: The toxicity model is beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` that all stages keep, as the mixture uses them, with shard and slot; none for an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
