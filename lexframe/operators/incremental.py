"""Change detection and index maintenance: fingerprints, hashes, snapshot differences, cache. The store is in ``store``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_hash

REPORT = "norm_id string, status string, reason string, changed long, removed long, unchanged long"
NOTHING_IN_FORCE = "no provisions in force"
NOT_HASHED = ("consolidated_as_of", "chunk_id")


def fingerprints(index: DataFrame, key: str = "norm_id", order: str = "ord", block: str = "block_id", day: str = "updated_at") -> DataFrame:
    """(key, fingerprint): SHA-256 of the ordered (block, day) list, so that order counts."""
    entry = F.struct(F.col(order).alias("o"), F.col(block).cast("string").alias("b"), F.date_format(day, "yyyy-MM-dd").alias("d"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(F.lit('["'), e["b"], F.lit('", "'), e["d"], F.lit('"]'))), ", ")
    return index.groupBy(key).agg(F.sha2(F.concat(F.lit("["), listed, F.lit("]")), 256).alias("fingerprint"))


def content_hashes(chunks: DataFrame, keys=("norm_id", "block_id"), order: str = "seq") -> DataFrame:
    """(keys, hash) of all that is indexed for a block but for fields that change with the whole norm."""
    columns = sorted(c for c in chunks.columns if c not in NOT_HASHED)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.to_json(F.struct(*columns)).alias("j"))))
    return chunks.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["j"]), "\n"), 256).alias("hash"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], hash_col: str = "hash") -> DataFrame:
    """(keys, change): "new", "changed", "removed" or "same", by one full outer join."""
    left, right = old.select(*keys, F.col(hash_col).alias("__old")), new.select(*keys, F.col(hash_col).alias("__new"))
    change = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "same").otherwise("changed")
    return left.join(right, keys, "full").select(*keys, change.alias("change"))


def due(specs: DataFrame, state: DataFrame, current: DataFrame, day, force: bool = False) -> DataFrame:
    """(norm_id, reason): why a norm must be processed, null if it need not. ``state`` has fingerprint and next_change; a norm
    that ``current`` lacks has an empty index, so ``specs`` must name norms that were fetched only."""
    joined = specs.select("norm_id").join(state.select("norm_id", F.col("fingerprint").alias("__old"), "next_change"), "norm_id", "left").join(current, "norm_id", "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))
    reason = F.when(F.col("__old").isNull(), "not indexed")
    if force:
        reason = reason.otherwise("forced")
    else:
        reason = reason.when(~F.col("fingerprint").eqNullSafe(F.col("__old")), "index changed").when(F.col("next_change") <= F.lit(day), "scheduled change")
    return joined.select("norm_id", reason.alias("reason"))


def forget(state: DataFrame, catalog: DataFrame, key: str = "norm_id") -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed keys) of a state whose catalog has changed."""
    return state.join(catalog.select(key), key, "left_semi"), state.select(key).distinct().join(catalog.select(key), key, "left_anti")


def embed_with_cache(texts: DataFrame, cache: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame], text_col: str = "embed_text", keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    """(texts with vectors, new cache rows): each distinct text not in the cache for this model is embedded once.

    The new rows feed both results, so ``keep`` holds them: in Spark's cache, or as a table that ``Store.stage`` has written.
    """
    hashed = texts.withColumn("text_hash", text_hash(F.col(text_col)))
    known = cache.where(F.col("model") == model).select("text_hash", "vector")
    wanted = hashed.groupBy("text_hash").agg(F.min(text_col).alias(text_col)).join(known, "text_hash", "left_anti")
    fresh = keep(embed(wanted))
    return hashed.join(known.unionByName(fresh.select("text_hash", "vector")), "text_hash"), fresh.select("text_hash", F.lit(model).alias("model"), "vector")


def cache_lookup(texts: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_hash, copies, cached) of the distinct texts."""
    found = texts.groupBy(text_hash(F.col(text_col)).alias("text_hash")).agg(F.count("*").alias("copies"))
    return found.join(cache.select("text_hash", F.lit(True).alias("__hit")).distinct(), "text_hash", "left").select("text_hash", "copies", F.coalesce("__hit", F.lit(False)).alias("cached"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` inserted or put in place of those of equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of rows with equal keys the last one."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("__n = 1").drop("__n")


def patch(chunks: DataFrame, norm_dates: DataFrame, column: str = "consolidated_as_of") -> DataFrame:
    """``chunks`` with a norm-wide column taken from ``norm_dates`` where it has one."""
    new = norm_dates.select("norm_id", F.col(column).alias("__new"))
    return chunks.join(new, "norm_id", "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def sync_report(diff: DataFrame, reasons: DataFrame) -> DataFrame:
    """(norm_id, status, reason, changed, removed, unchanged): one row per norm."""
    counted = diff.groupBy("norm_id").agg(F.count_if(F.col("change").isin("new", "changed")).alias("changed"), F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.col("change") == "same").alias("unchanged"))
    status = F.when(F.col("reason").isNull(), "skipped").when(F.col("reason") == NOTHING_IN_FORCE, "failed").when(F.col("reason") == "not indexed", "created").otherwise("updated")
    joined = reasons.join(counted, "norm_id", "left")
    return joined.select("norm_id", status.alias("status"), "reason", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("changed", "removed", "unchanged")])


def signature(version: str, model: str, limit: int) -> str:
    """What an index was built with; another signature means that it must be rebuilt."""
    return f"{version}|{model}|{limit}"
