"""The catalog of norms: a small ordered dimension."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from . import schema


def norms(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Catalog from mappings (as a YAML or JSON file holds them), in their order; missing members are null."""
    names = [c.split(" ")[0] for c in schema.NORMS.split(", ")]
    rows = [{**row, "ord": i} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(row.get(n, [] if n in ("aliases", "topics") else None) for n in names) for row in rows], schema.NORMS)


def get(catalog: DataFrame, norm_id: str) -> dict:
    """The norm of that id; KeyError if there is none."""
    row = catalog.where(F.col("norm_id") == norm_id).first()
    if row is None:
        raise KeyError(norm_id)
    return row.asDict(recursive=True)


def aliases(catalog: DataFrame) -> DataFrame:
    """(norm_id, alias, length, ord): short names and aliases, normalised; order of use is length descending, then ord."""
    names = F.array_union(F.array("short_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    exploded = catalog.select("norm_id", "ord", F.posexplode(F.transform(names, normalize)).alias("pos", "alias"))
    return exploded.select("norm_id", "alias", F.length("alias").alias("length"), (F.col("ord") * 1000 + F.col("pos")).alias("ord"))
