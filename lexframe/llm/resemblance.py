"""Near-duplicates by the Jaccard similarity of their word shingles, all of them: SimHash first, prefix filtering for the rest.

Texts whose fingerprints of the same shingles differ in a few bits are found by the vantage-point shards of ``simhash`` and
confirmed on their whole sets. Texts that are ``similarity`` alike may differ in more bits than any vantage point can prune
by, so the other links come from an exact join. If two sets are ``similarity`` alike and both are put in one order, the first
n - ceil(similarity * n) + 1 of each share a member; so the texts that hold a shingle in that prefix are a list, and every
pair sought is in some list. The order is by hash, with shingles common in a sample last, so that a common line does not
bring unrelated texts together. Shingles that occur once are kept out by a sketch before lists are made. In each list a few
texts at a time lead: they are compared, by their whole sets, with those of the list that are not in their group yet.
A group of near copies so costs a few comparisons a text, while texts of different groups are all compared.

Tuning: one of ``SAMPLE`` different texts is drawn, a shingle that ``COMMON`` of them hold is moved back (at most ``MOST_COMMON``,
8 bytes each, are sent to the executors), and ``LEADERS`` is how many lead in each round; the last round takes all that are
left. All of them change the cost only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash, sketch
from .common import cut, discard, utf8
from .graph import connected_components

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
REACH = 2
SAMPLE = 32
COMMON = 3
MOST_COMMON = 1 << 20
LEADERS = (8, 64, None)
NEAR_ZERO = 1e-9

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _digest(text: bytes | None) -> tuple[int, bytes, int]:
    """(hash of the lower-case words, the words joined, their number); zero without words."""
    words = text.lower().split() if text else []
    joined = b" ".join(words)
    return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64)) if words else 0, joined, len(words)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("raw"), utf8(text_col).alias("text"))


def _prefixes(texts: DataFrame, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(doc_id, raw, digest, fp, n, prefix) of every row; members of ``common`` come last in the order."""
    held = texts.sparkSession.sparkContext.broadcast(common)
    names = ["doc_id", "raw", "digest", "fp", "n", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held.value
        for batch in batches:
            digests, prints, sizes, prefixes = [], [], [], []
            for text in batch.column(2):
                digest, joined, count = _digest(text.as_py())
                whole = simhash.shingle_hashes(joined, count, shingle)
                own = np.unique(whole)
                taken = len(own) - math.ceil(similarity * len(own) - NEAR_ZERO) + 1 if len(own) else 0
                if len(own):
                    late = np.zeros(len(own), bool)
                    if len(last):
                        late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                    own = own[np.lexsort((own * _SPREAD, late))]
                digests.append(digest)
                prints.append(simhash.fingerprint(whole))
                sizes.append(len(own))
                prefixes.append(own[:taken].view(np.int64))
            columns = [pa.array(digests, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return texts.mapInArrow(run, "doc_id long, raw long, digest long, fp long, n int, prefix array<long>")


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) for the texts of ``wanted`` (digest, doc, raw), each read again by its id and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column(1):
                _, joined, count = _digest(text.as_py())
                sets.append(np.unique(simhash.shingle_hashes(joined, count, shingle)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    named = wanted.select(F.col("digest").alias("node"), "doc", F.col("raw").alias("__raw"))
    found = texts.join(named, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("raw") == F.col("__raw")))
    return found.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """Ascending hashes of the shingles that several of a sample of the different texts hold, the most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(simhash.shingle_hashes(*_digest(t.as_py())[1:], shingle)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["raw", "shingles"])

    sample = texts.where(F.pmod(F.col("raw"), F.lit(SAMPLE)) == 0).dropDuplicates(["raw"]).select("raw", "text")
    drawn = sample.mapInArrow(run, "raw long, shingles array<long>")
    found = drawn.select(F.explode("shingles").alias("key")).groupBy("key").count().where(F.col("count") >= COMMON)
    most = found.orderBy(F.desc("count"), "key").limit(MOST_COMMON).select("key")
    return np.sort(most.toArrow()["key"].to_numpy().view(np.uint64))


def _confirmed(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (u, v) among ``pairs`` whose whole sets are alike.

    Of the two prefixes one ends first in the order; its members that the other text holds are in the other's prefix. So no
    more is shared than the prefixes share and what lies beyond one of them; pairs that this rules out need no whole sets.
    """
    first, second = (nodes.select(F.col("digest").alias(c), F.col("n").alias(f"{c}_n"), F.col("prefix").alias(f"{c}_prefix")) for c in "uv")
    most = F.size(F.array_intersect("u_prefix", "v_prefix")) + F.greatest(F.col("u_n") - F.size("u_prefix"), F.col("v_n") - F.size("v_prefix"))
    possible = (most + NEAR_ZERO) * (1 + similarity) >= similarity * (F.col("u_n") + F.col("v_n"))
    pairs = cut(pairs.join(second, "v").join(first, "u").where(possible).select("u", "v"), "possible")
    wanted = nodes.select("digest", "doc", "raw").join(pairs.select(F.explode(F.array("u", "v")).alias("digest")).distinct(), "digest", "left_semi")
    wanted = cut(wanted, "wanted")  # its size is known now, so that Spark need not shuffle the texts if it is small
    sets = cut(_sets(texts, wanted, shingle), "sets")
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "uv")
    both = pairs.join(right, "v").join(left, "u").withColumn("shared", F.size(F.array_intersect("u_set", "v_set")))
    union = F.size("u_set") + F.size("v_set") - F.col("shared")
    alike = cut(both.where(F.col("shared") >= similarity * union - NEAR_ZERO).select("u", "v").distinct(), "alike")
    discard(pairs, sets, wanted)
    return alike


def _by_fingerprint(nodes: DataFrame, reach: int) -> DataFrame:
    """Pairs (u, v) of texts that spanning links between fingerprints suggest, and of texts with one fingerprint."""
    first = cut(nodes.groupBy("fp").agg(F.min("digest").alias("digest")), "by-fingerprint")
    named = lambda c: first.select(F.col("fp").alias(c), F.col("digest").alias(f"{c}_digest"))
    near = simhash.links(first.select("fp"), reach).join(named("u"), "u").join(named("v"), "v").select(F.col("u_digest").alias("u"), F.col("v_digest").alias("v"))
    same = nodes.select("fp", F.col("digest").alias("v")).join(first.withColumnRenamed("digest", "u"), "fp").where("u <> v").select("u", "v")
    return cut(near.unionByName(same).distinct(), "near")


def _lists(nodes: DataFrame) -> DataFrame:
    """(node, n, at, key) of the members of prefixes that may be in several."""
    bits = sketch.bits_for(nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield np.asarray(batch.column(0).flatten(), np.int64).view(np.uint64)

    repeated = cut(sketch.repeated_cells(nodes.select("prefix"), keys, bits), "cells")
    postings = nodes.select(F.col("digest").alias("node"), "n", F.posexplode("prefix").alias("at", "key"))
    return sketch.estimated_repeated(postings, "key", repeated, bits)


def _links(texts: DataFrame, nodes: DataFrame, shingle: int, similarity: float, reach: int) -> DataFrame:
    """Links (u, v) that join all texts connected by pairs that are alike."""
    checked = [_by_fingerprint(nodes, reach)]
    links = [_confirmed(checked[0], texts, nodes, shingle, similarity)]
    lists = cut(_lists(nodes), "lists")
    for leading in LEADERS:
        groups = connected_components(reduce(DataFrame.unionByName, links))
        labelled = lists.drop("label").join(groups, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        labelled = cut(labelled, "labelled")
        several = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
        rest = cut(labelled.join(several, "key", "left_semi"), "lists")
        discard(lists, labelled)
        lists = rest
        if lists.isEmpty():
            break
        first = lists
        if leading:
            place = F.row_number().over(Window.partitionBy("key").orderBy("node"))
            first = cut(lists.withColumn("place", place).where(F.col("place") <= leading).drop("place"), "leaders")
        led = first.select("key", F.col("node").alias("u"), F.col("n").alias("u_n"), F.col("at").alias("u_at"), F.col("label").alias("u_label"))
        both = led.join(lists, "key").where("u < node and u_label <> label")
        beyond = F.least(F.col("u_n") - F.col("u_at"), F.col("n") - F.col("at"))
        both = both.where((beyond + NEAR_ZERO) * (1 + similarity) >= similarity * (F.col("u_n") + F.col("n")))
        pairs = both.select("u", F.col("node").alias("v")).distinct().join(reduce(DataFrame.unionByName, checked), ["u", "v"], "left_anti")
        checked.append(cut(pairs, "pairs"))
        links.append(_confirmed(checked[-1], texts, nodes, shingle, similarity))
        if leading:  # leaders were compared with all others
            rest = cut(lists.join(first.select("key", "node"), ["key", "node"], "left_anti"), "lists")
            discard(lists, first)
            lists = rest
    discard(lists, *checked)
    return reduce(DataFrame.unionByName, links)


def _linked(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, reach: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, raw, digest) and the links (u, v) between the digests of their texts."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    texts = _texts(docs, id_col, text_col)
    keyed = cut(_prefixes(texts, shingle, similarity, _common(texts, shingle)), "prefixes")
    rows = cut(keyed.select("doc_id", "raw", "digest"), "rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), "raw")).alias("least")
    nodes = keyed.groupBy("digest").agg(least, *[F.first(c).alias(c) for c in ("fp", "n", "prefix")])
    nodes = cut(nodes.select("digest", "fp", "n", "prefix", "least.doc", "least.raw"), "nodes")
    discard(keyed)
    links = cut(_links(texts, nodes, shingle, similarity, reach), "alike")
    discard(nodes)
    return rows, links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: (doc_id, component_id); texts whose sets of ``shingle``-word shingles have a Jaccard
    similarity of at least ``similarity`` are linked, and so are texts of the same lower-case words, blank and null ones included.

    Rows of one doc_id count as one document, which links the groups of all its texts. A null doc_id cannot name a group: such
    rows take the group of their text, or null if nobody else is in it. An empty table gives an empty one. ``docs`` is read
    several times and must give the same rows; other columns are not read. ``reach`` changes the cost only.
    """
    rows, links = _linked(docs, id_col, text_col, shingle, similarity, reach)
    return simhash.name_rows(rows.select("doc_id", "digest"), links, "digest").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, reach: int = REACH) -> DataFrame:
    """One row of each group of ``docs``, columns unchanged (see ``simhash.drop_rows``). Here each text of a repeated id is a
    document of its own, so that no text goes that resembles none of those that stay."""
    rows, links = _linked(docs, id_col, text_col, shingle, similarity, reach)
    nodes = cut(rows.select("digest").distinct(), "nodes")
    found = rows.join(simhash.rooted(nodes, links, "digest"), "digest").select("doc_id", "raw", "root")
    return simhash.drop_rows(docs, found, id_col, text_col)
