"""The engine: ingest, search, ask and evaluate over one versioned store."""

from __future__ import annotations

import logging
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..observability import Timings
from ..operators import answering, chunking, dense, evaluation, incremental, lexical, retrieval, structure
from ..operators.store import Buckets, Segment, Store
from ..sources import schema

STATE = "norm_id string, fingerprint string, next_change date, consolidated_as_of date, synced_at string"
HASHES = "norm_id string, block_id string, hash string"
CACHE = "text_hash string, model string, vector array<float>"
VECTORS = "norm_id string, block_id string, chunk_id string, vector array<float>"
POSTINGS = "norm_id string, block_id string, chunk_id string, n_terms int, term string, tf long"
META = "key string, value string"
CHUNKS = "chunk_id string, norm_id string, norm_short_name string, block_id string, seq int, kind string, label string, number string, heading string, apartado string, hierarchy array<string>, text string, embed_text string, url string, version_in_force_since date, block_updated_at date, consolidated_as_of date, repealed boolean, jurisdiction string, legal_effect string, rank string, topics array<string>, application_date date, refs_out array<string>"
LENGTHS = (3, 2000)
log = logging.getLogger(__name__)


class Engine:
    """``root`` is a folder that all executors see. ``embedder`` has a ``name`` and maps texts to unit vectors."""

    def __init__(self, spark: SparkSession, root: str, norms: DataFrame, embedder=None, scorer: retrieval.Scorer | None = None, generate=answering.extractive, pricing: DataFrame | None = None, limit: int = chunking.MAX_CHARS):
        self.spark, self.norms, self.limit = spark, norms, limit
        self.store = Store(spark, root)
        self.embedder, self.scorer, self.generate = embedder or dense.HashEmbedder(), scorer, generate
        self.pricing = pricing if pricing is not None else spark.createDataFrame([], schema.PRICING)

    def _chunks(self) -> DataFrame:
        return self.store.read("chunks", CHUNKS)

    def sync(self, blocks: DataFrame, block_index: DataFrame, day: date, force: bool = False, only: DataFrame | None = None) -> DataFrame:
        """Brings the store up to date and returns the report, one row per norm. Unchanged norms are not processed, and where
        nothing is due nothing is written.

        ``blocks`` and ``block_index`` are those of the whole catalog, or of the norms in ``only`` (norm_id): then no other
        norm is processed or reported. Norms that the catalog lacks are removed in both cases; norms without any block were
        not fetched, are skipped and stay as they are; a due norm without any provision in force is reported as failed and stays too.
        Vectors of another dimension than the held ones are an error. New tables are computed first and take effect together, so a failure leaves the old state.
        """
        try:
            return self._sync(blocks, block_index, day, force, only)
        finally:
            self.store.unstage()

    def _sync(self, blocks: DataFrame, block_index: DataFrame, day: date, force: bool, only: DataFrame | None) -> DataFrame:
        stage = self.store.stage
        signature = incremental.signature(__version__, self.embedder.name, self.limit)
        meta = self.store.read("meta", META)
        same = not meta.where((F.col("key") == "signature") & (F.col("value") == signature)).isEmpty()
        # An index built otherwise counts as empty; its embeddings are of use still.
        read = lambda table, kind, buckets=None: self.store.read(table, kind, buckets) if same else self.spark.createDataFrame([], kind)
        state, gone = incremental.forget(read("state", STATE), self.norms)
        current = incremental.fingerprints(block_index)
        delivered = self.norms if only is None else self.norms.join(only.select("norm_id").distinct(), "norm_id", "left_semi")
        fetched = blocks.select("norm_id").distinct()
        absent = delivered.join(fetched, "norm_id", "left_anti").select("norm_id", F.lit(None).cast("string").alias("reason"))
        reasons = stage(incremental.due(delivered.join(fetched, "norm_id", "left_semi"), state, current, day, force).unionByName(absent), "reasons")
        todo = reasons.where("reason is not null").select("norm_id")
        specs = self.norms.join(todo, "norm_id", "left_semi")
        own = stage(blocks.join(todo, "norm_id", "left_semi"), "blocks")

        provisions = stage(structure.build_provisions(own, specs, block_index, day), "provisions")
        chunks = stage(chunking.chunk_provisions(provisions, specs, self.limit), "chunks")
        # A norm of which nothing is in force was scoped or dated wrongly: it fails by itself, and what is indexed of it stays.
        empty = stage(todo.join(chunks.select("norm_id").distinct(), "norm_id", "left_anti"), "empty")
        todo = todo.join(empty, "norm_id", "left_anti")
        failed = empty.withColumn("failed", F.lit(incremental.NOTHING_IN_FORCE))
        reasons = reasons.join(failed, "norm_id", "left").select("norm_id", F.coalesce("failed", "reason").alias("reason"))
        hashes = incremental.content_hashes(chunks)
        # Norms lie in buckets: only those of norms that are due or gone are read and written, or all if the index starts anew.
        touched = self.store.touched(todo, gone) if same else None
        old_hashes = read("hashes", HASHES, touched)
        diff = stage(incremental.snapshot_diff(old_hashes.join(todo, "norm_id", "left_semi"), hashes, ["norm_id", "block_id"]), "diff")
        # The report outlives the state that it was made of, so its few rows are fixed here.
        report = self.spark.createDataFrame(incremental.sync_report(diff, reasons).collect(), incremental.REPORT)
        if same and gone.isEmpty() and todo.isEmpty():
            return report

        changed = diff.where("change in ('new', 'changed')").select("norm_id", "block_id")
        stale = diff.where("change in ('changed', 'removed')").select("norm_id", "block_id")
        drop = lambda df: df.join(stale, ["norm_id", "block_id"], "left_anti").join(gone, "norm_id", "left_anti")
        fresh = chunks.join(changed, ["norm_id", "block_id"], "left_semi")
        embed = lambda wanted: dense.embed(wanted, self.embedder, "text_hash", "embed_text")
        wanted = fresh.select("norm_id", "block_id", "chunk_id", "embed_text")
        cache = self.store.read("cache", CACHE)
        embedded, added = incremental.embed_with_cache(wanted, cache, self.embedder.name, embed, keep=lambda df: stage(df, "embedded"))
        held = read("vectors", VECTORS, touched).select(F.size("vector").alias("n")).first()
        embedded = embedded if held is None else dense.check_dimension(embedded, held["n"])
        terms = lexical.postings(fresh, "chunk_id", "embed_text", True, ("norm_id", "block_id"))

        dates = chunks.groupBy("norm_id").agg(F.max("consolidated_as_of").alias("consolidated_as_of"))
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        renewed = todo.join(current, "norm_id", "left").join(structure.next_scheduled_change(own, specs, day), "norm_id").join(dates, "norm_id", "left").select("norm_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), "next_change", "consolidated_as_of", now.alias("synced_at"))
        part = lambda table, kind: drop(read(table, kind, touched))
        dead = stale.unionByName(old_hashes.join(gone, "norm_id", "left_semi").select("norm_id", "block_id"))
        self.store.commit(
            chunks=Buckets(incremental.patch(part("chunks", CHUNKS).unionByName(fresh), dates), "norm_id", touched),
            vectors=Buckets(part("vectors", VECTORS).unionByName(embedded.select("norm_id", "block_id", "chunk_id", "vector")), "norm_id", touched),
            postings=Segment(terms.select("norm_id", "block_id", "chunk_id", "n_terms", "term", "tf"), "term", dead, fresh=not same),
            hashes=Buckets(old_hashes.join(gone, "norm_id", "left_anti").join(todo, "norm_id", "left_anti").unionByName(hashes), "norm_id", touched),
            state=incremental.upsert(state, renewed, ["norm_id"]),
            cache=Segment(added, "text_hash"),
            meta=incremental.upsert(meta, self.spark.createDataFrame([("signature", signature)], META), ["key"]),
        )
        log.info("synced", extra={"norms": report.count()})
        return report

    def statistics(self, blocks: DataFrame, block_index: DataFrame, day: date) -> DataFrame:
        """What ``sync`` would index, per norm, without writing."""
        provisions = structure.build_provisions(blocks, self.norms, block_index, day)
        return structure.norm_statistics(self.norms, provisions, chunking.chunk_provisions(provisions, self.norms, self.limit))

    def search(self, queries: DataFrame, k: int = retrieval.TOP_K, mode: str = "hybrid", chunk_filter: retrieval.ChunkFilter | None = None, use_references: bool = True, scorer: retrieval.Scorer | str | None = "own", timings: Timings | None = None) -> DataFrame:
        """Hits of (query_id, query) rows, with the chunks' columns; the norm's rank is ``norm_rank``. ``scorer`` is the engine's
        unless another one, or None for none, is given. ``timings`` takes the milliseconds of the stages that run here."""
        timings = timings or Timings()
        chunks = self._chunks()
        if mode != "sparse":
            with timings.stage("embed"):
                vectors = dense.embed(queries, self.embedder, "query_id", "query").withColumnRenamed("vector", "query_vector")
                queries = queries.join(vectors, "query_id")
        with timings.stage("retrieve"):
            scorer = self.scorer if scorer == "own" else scorer
            hits = retrieval.retrieve(chunks, queries, self.norms, k, mode, chunk_filter, self.store.read("vectors", VECTORS), use_references, scorer, postings=self.store.parts("postings", POSTINGS))
        return hits.join(chunks.withColumnRenamed("rank", "norm_rank"), "chunk_id")

    def _asked(self, queries: DataFrame, day: date, k: int, chunk_filter: retrieval.ChunkFilter | None, abstain_below: float | None) -> tuple[DataFrame, DataFrame]:
        """(sources, events of the model) of the queries."""
        wrong = F.raise_error(F.lit(f"a question has {LENGTHS[0]} to {LENGTHS[1]} characters")).cast("boolean")
        queries = queries.where(F.when(F.length("query").between(*LENGTHS), True).otherwise(wrong))
        hits = self.store.keep(self.search(queries, k, "hybrid", chunk_filter))
        label = chunking.citation_label(F.col("norm_short_name"), F.col("kind"), F.col("number"), F.col("label"), F.col("apartado"))
        title = answering.result_title(label, F.col("heading"), F.col("consolidated_as_of"), F.col("application_date"), F.col("repealed"), day)
        block = answering.context_block(F.col("norm_short_name"), F.col("hierarchy"), F.col("label"), F.col("text"), F.col("url"), title)
        prompts = answering.prompts(queries, hits.select("query_id", "rank", block.alias("block")), day)
        texts = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("index"), "text"))).alias("sources"))
        asked = prompts.join(answering.abstentions(queries, hits, abstain_below), "query_id").join(texts, "query_id", "left")
        counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
        found = answering.sources(hits.withColumn("citation", label), day)
        return found, answering.in_range(answering.generate(asked, self.generate), counts)

    def ask(self, queries: DataFrame, day: date, k: int = retrieval.TOP_K, chunk_filter: retrieval.ChunkFilter | None = None, abstain_below: float | None = None) -> DataFrame:
        """One row per query: the folded answer with its cost, its sources, which of them it cites, and what to be warned of.
        Queries that abstain do not reach the model."""
        found, events = self._asked(queries, day, k, chunk_filter, abstain_below)
        folded = answering.fold_events(events)
        listed = answering.cited_and_uncited(found, folded).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "chunk_id", "citation", "score", "retrieved_by", "cited"))).alias("sources"))
        warned = answering.applicability_warnings(found).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "code", "message"))).alias("warnings"))
        return answering.costs(folded, self.pricing).join(listed, "query_id", "left").join(warned, "query_id", "left")

    def ask_events(self, queries: DataFrame, day: date, k: int = retrieval.TOP_K, chunk_filter: retrieval.ChunkFilter | None = None, abstain_below: float | None = None) -> DataFrame:
        """(query_id, seq, type, data): sources, warnings, the model's deltas and citations, what its end means, done."""
        return answering.event_stream(*self._asked(queries, day, k, chunk_filter, abstain_below))

    def overview(self) -> DataFrame:
        """Catalog with the state and the number of chunks of every norm; norms that are not indexed have none."""
        counts = self._chunks().groupBy("norm_id").agg(F.count("*").alias("chunks"))
        return self.norms.join(self.store.read("state", STATE), "norm_id", "left").join(counts, "norm_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))

    def readiness(self, answering_ready: bool = True) -> DataFrame:
        """(check, ok): whether the store can be read, has chunks, and answers can be given."""
        try:
            n = self._chunks().limit(1).count()
            checks = [("store", True), ("chunks", n > 0)]
        except Exception:  # whatever keeps the store from being read makes it not ready
            log.exception("store")
            checks = [("store", False), ("chunks", False)]
        return self.spark.createDataFrame([*checks, ("answering", bool(answering_ready and self.generate))], "check string, ok boolean")

    def evaluate(self, questions: DataFrame, gold: DataFrame, configs: list[str], k: int = max(evaluation.KS)) -> DataFrame:
        """Means by configuration ("mode[+refs][+rerank]") and category. ``gold`` has (id, norm_id, kind, number, block_id).
        However many configurations there are, postings and vectors are searched once."""
        kept = evaluation.checked_questions(questions, gold).where("category <> 'out_of_scope'")
        keyed = gold.withColumn("gold", F.concat_ws("#", "norm_id", "kind", "number", "block_id"))
        queries = kept.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
        vectors = dense.embed(queries, self.embedder, "query_id", "query").withColumnRenamed("vector", "query_vector")
        chunks, scorer = self._chunks(), self.scorer or retrieval.lexical_overlap
        found = retrieval.retrieve_grid(chunks, queries.join(vectors, "query_id"), self.norms, configs, k, self.store.read("vectors", VECTORS), scorer, self.store.parts("postings", POSTINGS), self.store.keep)
        hits = self.store.keep(found.join(chunks.select("chunk_id", "norm_id", "kind", "number", "block_id"), "chunk_id"))
        asked = keyed.select(*[F.col(c).alias(f"g_{c}") for c in ("id", "norm_id", "kind", "number", "block_id")], "gold")
        match = (F.col("query_id") == F.col("g_id")) & (F.col("norm_id") == F.col("g_norm_id")) & (F.col("kind") == F.col("g_kind")) & evaluation.gold_matches(F.col("g_block_id"), F.col("g_number"), F.col("block_id"), F.col("number"))
        both = lambda question: F.struct("config", F.col(question).alias("id")).alias("asked")
        matched = hits.join(asked, match).select(both("g_id"), "gold", F.col("rank").cast("int").alias("rank"))
        every = keyed.select("id", "gold").distinct().withColumn("config", F.explode(F.array(*map(F.lit, dict.fromkeys(configs)))))
        scores = evaluation.score_questions(every.select(both("id"), "gold"), matched, "asked").select("asked.*", *[f"recall_at_{n}" for n in evaluation.KS], "reciprocal_rank").join(kept.select("id", "category"), "id")
        return evaluation.summarise(scores)
