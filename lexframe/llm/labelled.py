"""A bounded sample of the labelled rows that may be learnt from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold

FRACTION_BITS = 30


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of about ``most`` labelled rows at the most, drawn by hash; ids of the held-out fold never appear.

    An id with contradicting labels takes the greater one; null ids and labels are ignored. Rows that repeat an id are examples
    each if their texts differ, one if not; if such rows are more than ``most``, they are drawn by hash too. Columns may have any names.
    """

    def drawn(rows: DataFrame, n: int, *keys: str) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64(*keys, F.lit("train")), F.lit(1 << FRACTION_BITS)) < int(most / n * (1 << FRACTION_BITS))) if n > most else rows

    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, folds) != held_out))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    usable = drawn(usable, usable.count(), "id")  # about ``most`` ids, so it may be broadcast
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), text_col).alias("h2"))
    named = slim.join(F.broadcast(usable), "id")
    keys = named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if keys.isEmpty():
        return named.select("text", "label")
    once = cut(named.dropDuplicates(["id", "h1", "h2"]), "training-rows")
    return drawn(once, once.count(), "id", "h1").select("text", "label")
