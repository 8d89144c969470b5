"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _stars(pairs: DataFrame, emit_self: bool) -> DataFrame:
    """Every neighbour v of u, and u itself if asked, is linked to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = pairs.join(least, "u")
    out = linked.where("v > u" if not emit_self else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if emit_self:
        out = out.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of longs -> (node, component), component being the least node reachable.

    Self-links, nulls and repeated links are ignored; a node without links is not returned. The minimum over a hub's
    neighbours is combined before the shuffle, and the join with it is one that Spark may split when skewed.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, emit_self=False)
        large = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large")
        smaller = cut(_stars(large, emit_self=True), "small")
        discard(edges, large)
        edges = smaller
        after = _state(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
