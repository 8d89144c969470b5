"""Filters, fusion, reranking, merging, and retrieval as their composition, for batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from . import dense, evaluation, lexical, references
from .lexical import ROUND

RRF_K = 60
CANDIDATES, RERANK_CANDIDATES, TOP_K = 50, 20, 8


@dataclass(frozen=True)
class ChunkFilter:
    """Members are alternatives, different members must all hold; repealed chunks are left out unless asked for. A null member
    does not match: the predicate may be null, which a filter drops, and is a conjunction that Spark pushes to the scan."""

    norm_ids: Sequence[str] = ()
    topics: Sequence[str] = ()
    jurisdictions: Sequence[str] = ()
    include_repealed: bool = False
    columns: dict[str, str] = field(default_factory=dict)

    def predicate(self) -> Column:
        name = lambda c: F.col(self.columns.get(c, c))
        keep = F.lit(True)
        if self.norm_ids:
            keep &= name("norm_id").isin(*self.norm_ids)
        if self.jurisdictions:
            keep &= name("jurisdiction").isin(*self.jurisdictions)
        if self.topics:
            keep &= F.arrays_overlap(name("topics"), F.array(*map(F.lit, self.topics)))
        if not self.include_repealed:
            keep &= ~F.coalesce(name("repealed"), F.lit(False))
        return keep


@dataclass(frozen=True)
class Model:
    """A reranking model: ``scores`` maps lists of queries and passages to a list of numbers, on Arrow batches in Python workers."""

    scores: Callable[[list[str], list[str]], list[float]]


Scorer = Callable[[Column, Column], Column] | Model


def fuse(rankings: dict[str, DataFrame], query_col: str, id_col: str, limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: (query, id, score, rank, sources); ``rankings`` by the name of their source, ranks from 1."""
    union = None
    for name, ranking in rankings.items():
        part = ranking.select(query_col, id_col, (1.0 / (F.lit(float(k)) + F.col("rank"))).alias("s"), F.lit(name).alias("source"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy(query_col, id_col).agg(F.round(F.sum("s"), ROUND + 2).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)))
    return ranked.where(F.col("rank") <= limit)


def lexical_overlap(query: Column, passage: Column) -> Column:
    """Share of the query's distinct terms that the passage holds: a deterministic stand-in for a cross-encoder."""
    asked = F.array_distinct(tokenize(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokenize(passage))) / F.size(asked)).otherwise(F.lit(0.0))


def model_scores(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], query_text: str = "query", passage: str = "passage") -> DataFrame:
    """``pairs`` with ``rerank_score`` from a pluggable scorer called on Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.astype(object).assign(rerank_score=pd.Series(scorer(frame[query_text].tolist(), frame[passage].tolist()), index=frame.index, dtype=float))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(run, schema + ", rerank_score double")


def passage(short_name: Column, label: Column, heading: Column, text: Column) -> Column:
    """What a reranker reads of a chunk: norm, label, heading if there is one, and text."""
    title = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(". "), heading)).otherwise(F.lit(""))
    return F.concat(short_name, F.lit(", "), label, title, F.lit("\n"), text)


def rerank(hits: DataFrame, query_col: str, rerank_score: Column, id_col: str = "chunk_id") -> DataFrame:
    """``hits`` with the new score, ranked by it; equal scores keep their order. The source "rerank" is added."""
    rescored = hits.withColumn("__prior", F.col("rank")).withColumn("score", F.round(rerank_score, ROUND))
    order = Window.partitionBy(query_col).orderBy(F.desc("score"), "__prior", id_col)
    return rescored.withColumn("rank", F.row_number().over(order)).withColumn("sources", F.array_append("sources", F.lit("rerank"))).drop("__prior")


def merge(first: DataFrame, second: DataFrame, query_col: str, id_col: str, k: int) -> DataFrame:
    """All of ``first`` in its order, then ``second``; of repeated ids the first stays; at most k of each query."""
    columns = [query_col, id_col, "score", "sources", "rank"]
    both = first.select(*columns, F.lit(0).alias("__part")).unionByName(second.select(*columns, F.lit(1).alias("__part")))
    earliest = Window.partitionBy(query_col, id_col).orderBy("__part", "rank")
    fresh = both.withColumn("__n", F.row_number().over(earliest)).where("__n = 1")
    order = Window.partitionBy(query_col).orderBy("__part", F.col("rank"))
    return fresh.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("__n", "__part")


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    catalog: DataFrame | None = None,
    k: int = TOP_K,
    mode: str = "hybrid",
    chunk_filter: ChunkFilter | None = None,
    vectors: DataFrame | None = None,
    use_references: bool = True,
    scorer: Scorer | None = None,
    candidates: int = CANDIDATES,
    rerank_candidates: int = RERANK_CANDIDATES,
    stems: bool = True,
    postings: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """(query_id, rank, chunk_id, score, sources) for ``queries`` (query_id, query, and query_vector for dense modes).

    The filter holds inside each branch, before its top k. Provisions cited in the query come first and are not reranked.
    With ``postings`` (of the chunks' ``embed_text``, and the number of their parts: see ``Store.parts``) texts are not tokenised. ``scorer`` is an expression
    of query and passage, or a ``Model``.
    """
    chunk_filter = chunk_filter or ChunkFilter()
    keep = chunk_filter.predicate()
    pool = max(k, rerank_candidates) if scorer else k
    depth = candidates if mode == "hybrid" else pool
    branches = {}
    if mode in ("sparse", "hybrid"):
        if postings is None:
            branches["sparse"] = lexical.search(chunks, queries, depth, "chunk_id", "embed_text", keep=keep, stems=stems)
        else:
            asked = lexical.asked_terms(queries, "query_id", "query", stems)
            branches["sparse"] = lexical.search_postings(postings[0], asked, depth, "chunk_id", "query_id", allowed=chunks.where(keep), parts=postings[1])
    if mode in ("dense", "hybrid"):
        allowed = vectors.join(chunks.where(keep).select("chunk_id"), "chunk_id", "left_semi")
        branches["dense"] = dense.search(allowed, queries, depth, "chunk_id", "vector")
    if mode == "hybrid":
        found = fuse(branches, "query_id", "chunk_id", pool)
    else:
        found = next(iter(branches.values())).withColumn("sources", F.array(F.lit(mode)))
    if scorer:
        passages = chunks.select("chunk_id", passage(F.col("norm_short_name"), F.col("label"), F.col("heading"), F.col("text")).alias("__passage"))
        texts = found.join(passages, "chunk_id").join(queries.select("query_id", F.col("query").alias("__query")), "query_id")
        if isinstance(scorer, Model):
            texts = model_scores(texts, scorer.scores, "__query", "__passage")
            found = rerank(texts, "query_id", F.col("rerank_score")).drop("__passage", "__query", "rerank_score")
        else:
            found = rerank(texts, "query_id", scorer(F.col("__query"), F.col("__passage"))).drop("__passage", "__query")
    if use_references and catalog is not None:
        refs = references.references(queries, catalog, "query_id", "query")
        cited = references.reference_hits(refs, chunks, "query_id", list(chunk_filter.norm_ids)).withColumnRenamed("place", "rank")
        return merge(cited, found, "query_id", "chunk_id", k)
    return found.where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "sources", "rank")


def retrieve_grid(
    chunks: DataFrame,
    queries: DataFrame,
    catalog: DataFrame,
    configs: Sequence[str],
    k: int,
    vectors: DataFrame,
    scorer: Scorer,
    postings: tuple[DataFrame, int],
    keep: Callable[[DataFrame], DataFrame],
    chunk_filter: ChunkFilter | None = None,
    candidates: int = CANDIDATES,
    rerank_candidates: int = RERANK_CANDIDATES,
) -> DataFrame:
    """(config, query_id, rank, chunk_id, score, sources): what ``retrieve`` gives for every configuration "mode[+refs][+rerank]".

    Each branch is searched once, to the greatest depth that a configuration asks for, and written by ``keep``; a pair of query and
    chunk is scored once. Configurations are a column, so fusion, reranking and merging are one plan for all of them.
    """
    spark, chunk_filter = queries.sparkSession, chunk_filter or ChunkFilter()
    named = spark.createDataFrame([(c,) for c in dict.fromkeys(configs)], "config string")
    grid = named.select("config", evaluation.parse_config(F.col("config")).alias("g")).select("config", "g.*")
    wide = max(k, rerank_candidates)
    grid = grid.withColumn("pool", F.when(F.col("rerank"), wide).otherwise(k))
    modes = {c.split("+")[0] for c in configs}
    if modes - {"sparse", "dense", "hybrid"}:
        raise ValueError(f"no such mode: {sorted(modes)}")
    depth = max(wide, candidates) if "hybrid" in modes else wide
    allowed = chunks.where(chunk_filter.predicate())
    branches = {}
    if modes & {"sparse", "hybrid"}:
        asked = lexical.asked_terms(queries, "query_id", "query", True)
        branches["sparse"] = keep(lexical.search_postings(postings[0], asked, depth, "chunk_id", "query_id", allowed=allowed, parts=postings[1]))
    if modes & {"dense", "hybrid"}:
        branches["dense"] = keep(dense.search(vectors.join(allowed.select("chunk_id"), "chunk_id", "left_semi"), queries, depth, "chunk_id", "vector"))
    columns = ["query_id", "chunk_id", "score", "sources", "rank"]
    lists = [branches[m].withColumn("sources", F.array(F.lit(m))).select(F.lit(m).alias("mode"), *columns) for m in branches if m in modes]
    if "hybrid" in modes:
        fused = fuse({m: b.where(F.col("rank") <= candidates) for m, b in branches.items()}, "query_id", "chunk_id", wide)
        lists.append(fused.select(F.lit("hybrid").alias("mode"), *columns))
    key = F.struct("config", "query_id").alias("asked")
    found = reduce(DataFrame.unionByName, lists).join(F.broadcast(grid), "mode").where(F.col("rank") <= F.col("pool")).select(key, *columns, "refs", "rerank")
    plain = found.where(~F.col("rerank"))
    again = found.where("rerank")
    if any("rerank" in c.split("+")[1:] for c in configs):
        passages = chunks.select("chunk_id", passage(F.col("norm_short_name"), F.col("label"), F.col("heading"), F.col("text")).alias("__passage"))
        pairs = again.select("query_id", "chunk_id").distinct().join(passages, "chunk_id").join(queries.select("query_id", F.col("query").alias("__query")), "query_id")
        if isinstance(scorer, Model):
            scored = model_scores(pairs, scorer.scores, "__query", "__passage")
        else:
            scored = pairs.withColumn("rerank_score", scorer(F.col("__query"), F.col("__passage")))
        scored = again.join(scored.select("query_id", "chunk_id", "rerank_score"), ["query_id", "chunk_id"])
        plain = plain.unionByName(rerank(scored, "asked", F.col("rerank_score")).drop("rerank_score"))
    plain = plain.drop("query_id")
    alone = plain.where(~F.col("refs")).where(F.col("rank") <= k)
    cited = references.reference_hits(references.references(queries, catalog, "query_id", "query"), chunks, "query_id", list(chunk_filter.norm_ids)).withColumnRenamed("place", "rank")
    told = [c for c in dict.fromkeys(configs) if "refs" in c.split("+")[1:]]
    cited = cited.withColumn("config", F.explode(F.array(*map(F.lit, told)) if told else F.array().cast("array<string>"))).withColumn("asked", key)
    merged = merge(cited, plain.where("refs"), "asked", "chunk_id", k)
    rest = ["chunk_id", "score", "sources", "rank"]
    return alone.select("asked.*", *rest).unionByName(merged.select("asked.*", *rest))
