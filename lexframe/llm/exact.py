"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

A first scan counts the lengths of the normalised texts. Only texts whose length others share have their first
characters hashed, in a second scan; only those whose length and prefix hash others share are hashed whole, in a third. The
rest is settled. Texts are never shuffled, only counts and hashes. Keys go to all executors if they are at most
``BROADCAST_KEYS`` (16 bytes each), otherwise survivors are matched by a shuffle of hashes. Counts are summed before the
shuffle, and a group's result is handed out under ``SALTS`` keys, so that a group of a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

PREFIX = 256
BROADCAST_KEYS = 1_000_000
SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is the empty text. Single spaces are left untouched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), " [ \\t-\\r]+|[\\t-\\r][ \\t-\\r]*", " ")


def _sharing(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The ``keys`` that several rows have."""
    return cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), label)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, and the columns of ``carry``).

    ``keep_id`` is the smallest doc_id with the same normalised text, nulls last; null texts are empty ones. Exactly one row of
    a group is kept, also if rows repeat that doc_id. An empty table gives an empty one. ``docs`` must give the same rows each
    time it is read; only the two columns and those of ``carry``, evaluated once a row, are read.
    """
    carry = carry or {}
    names = [f"carry_{n}" for n in carry]
    text = normalised(F.col(text_col).cast("string"))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *[c.alias(f"carry_{n}") for n, c in carry.items()]).withColumn("length", F.length("text"))

    lengths = _sharing(base.select("length"), ["length"], "exact-lengths")
    lengths = F.broadcast(lengths) if lengths.count() <= BROADCAST_KEYS else lengths
    prefix = F.xxhash64(F.substring("text", 1, PREFIX)).alias("prefix")
    sharing = base.join(lengths, "length", "left_semi").select("length", prefix)
    keys = _sharing(sharing, ["length", "prefix"], "exact-prefixes")

    rows, whole = base.withColumn("prefix", F.xxhash64(F.substring("text", 1, PREFIX))), F.sha2("text", 256).alias("whole")
    if keys.count() <= BROADCAST_KEYS:
        survivors = rows.join(F.broadcast(keys), ["length", "prefix"], "left_semi").select("doc_id", whole, *names)
        alone = rows.join(F.broadcast(keys), ["length", "prefix"], "left_anti").select("doc_id", *names)
    else:
        hashed = rows.select("doc_id", "length", "prefix", whole, *names)
        survivors = hashed.join(keys, ["length", "prefix"], "left_semi").drop("length", "prefix")
        alone = rows.select("doc_id", "length", "prefix", *names).join(keys, ["length", "prefix"], "left_anti").drop("length", "prefix")
    survivors = cut(survivors.withColumn("row", F.monotonically_increasing_id()), "exact-survivors")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = survivors.groupBy("whole").agg(first.alias("first"), F.count("*").alias("group_size"))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = survivors.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    grouped = salted.join(spread, ["whole", "salt"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), *names)
    settled = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *names)
    return grouped.unionByName(settled).withColumnsRenamed({f"carry_{n}": n for n in carry})


def exact_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's rows. Its digest of every text, settled ones too, is no part of the method: it is carried along, and so
    evaluated for survivors in the third scan and for settled texts in the scan that gives their rows."""
    digest = F.sha2(normalised(F.col(text_col).cast("string")), 256)
    found = exact_duplicates(docs, id_col, text_col, {"text_sha256": digest})
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
