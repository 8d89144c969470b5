"""Writers: chunks, query log, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, lines: bool = False) -> None:
    """Parquet, or JSON lines, a folder for each norm; only the folders of norms in ``chunks`` are replaced."""
    writer = chunks.repartition("norm_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("norm_id")
    writer.json(path) if lines else writer.parquet(path)


def append_log(answers: DataFrame, path: str) -> None:
    """One JSON line for each answered query."""
    answers.withColumn("ts", F.current_timestamp()).write.mode("append").json(path)


def write_report(summary: DataFrame, path: str, **attributes: str) -> None:
    """The evaluation summary as JSON lines with constant attributes (revision, time, model)."""
    summary.withColumns({k: F.lit(v) for k, v in attributes.items()}).coalesce(1).write.mode("overwrite").json(path)
