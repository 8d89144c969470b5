"""SimHash near-duplicates, linked exactly through overlapping vantage-point shards.

Fingerprints are compared once per distinct value. The top of a vantage-point tree is fitted on a bounded sample of
them and sent to all executors; it routes every fingerprint to a shard. A fingerprint whose distance to a vantage
point lies in (radius - reach, radius] goes to both sides: if two fingerprints differ in at most ``reach`` bits and are
parted there, the inner one is, by the triangle inequality, in that band, so some shard always holds both. Shards that are
still too large are parted again by trees of their own, fitted and applied on the executors, as often as their size asks for.
Inside a shard the same splitting goes on until a leaf is small enough to compare directly. A shard returns a spanning star
for each group it finds, never all pairs; the stars of all shards are joined by distributed connected components.

Tuning: ``shard_rows`` is the size of shard aimed at, ``LEVELS`` the depth of one tree, ``SAMPLE_PER_SHARD`` its sample (at most
SAMPLE_PER_SHARD * 2**LEVELS fingerprints in one place, whatever the input).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8
from .graph import connected_components

SEED = 42
SHINGLE = 3
REACH = 2
LEVELS = 12
SAMPLE_PER_SHARD = 64
LEAF = 384
CHUNK = 1 << 15
ROUTED_ROWS = 1 << 20
SHARD_ROWS = 8192
LARGE = 4
SALTS = 16


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes`` (uint64, repeats included)."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(joined: bytes, count: int, shingle: int) -> np.ndarray:
    """XXH64 of every ``shingle`` consecutive ones of ``count`` words joined by spaces; fewer words are one shingle."""
    if count <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if count else [], np.uint64)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begin = np.concatenate(([0], spaces + 1))[: count - shingle + 1].tolist()
    stop = np.concatenate((spaces, [len(joined)]))[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin, stop, strict=True)), np.uint64, len(begin))


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of the word shingles of ``text``, repeats included; zero without words."""
    words = text.lower().split() if text else []
    return fingerprint(shingle_hashes(b" ".join(words), len(words), shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, raw, fp) for every row; raw is a hash of the text, fp the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "raw", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("raw"), utf8(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, raw long, fp long")


def _split(points: np.ndarray, reach: int, rng: np.random.Generator, tries: int = 4) -> tuple[int, int] | None:
    """Vantage point and radius, near the median, whose overlap band holds the fewest of ``points``; None if none parts them."""
    best, found = len(points) * 0.8, None
    for point in rng.choice(points, min(tries, len(points)), replace=False):
        counts = np.bincount(np.bitwise_count(points ^ point), minlength=65)
        inside = np.cumsum(counts)
        for radius in np.flatnonzero((inside >= 0.3 * len(points)) & (inside <= 0.7 * len(points))).tolist():
            band = int(counts[max(0, radius - reach + 1) : radius + 1].sum())
            larger = max(int(inside[radius]), len(points) - int(inside[radius]) + band)
            if (cost := larger + 0.5 * band) < best:
                best, found = cost, (int(point), radius)
    return found


def _grow(sample: np.ndarray, depth: int, reach: int, rng: np.random.Generator, leaves: list[int]):
    """Nested (vantage point, radius, inner, outer); a leaf is its shard's number."""
    parting = _split(sample, reach, rng) if depth and len(sample) >= 16 else None
    if parting is None:
        leaves.append(len(leaves))
        return leaves[-1]
    point, radius = parting
    far = np.bitwise_count(sample ^ np.uint64(point)).astype(np.int64)
    inner = _grow(sample[far <= radius], depth - 1, reach, rng, leaves)
    return point, radius, inner, _grow(sample[far > radius - reach], depth - 1, reach, rng, leaves)


def _route(tree, prints: np.ndarray, rows: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows) pairs; a row in an overlap band comes up in several shards."""
    if isinstance(tree, int):
        yield tree, rows
        return
    point, radius, inner, outer = tree
    far = np.bitwise_count(prints[rows] ^ np.uint64(point)).astype(np.int64)
    for part, near in ((inner, far <= radius), (outer, far > radius - reach)):
        if near.any():
            yield from _route(part, prints, rows[near], reach)


class _Groups:
    """Union-find whose representative is the least node of a group."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.up = nodes, np.arange(len(nodes))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            low, high = (i, j) if self.nodes[i] < self.nodes[j] else (j, i)
            self.up[high] = low


def _compare(prints: np.ndarray, rows: np.ndarray, groups: _Groups, reach: int) -> None:
    """Links all pairs within reach, block against block."""
    own = prints[rows]
    for at in range(0, len(rows), LEAF):
        for to in range(at, len(rows), CHUNK):
            near = np.bitwise_count(own[at : at + LEAF, None] ^ own[None, to : to + CHUNK]) <= reach
            for i, j in zip(*np.nonzero(near), strict=True):
                if at + i < to + j:
                    groups.link(rows[at + i], rows[to + j])


def _search(prints: np.ndarray, rows: np.ndarray, groups: _Groups, reach: int, rng: np.random.Generator) -> None:
    todo = [rows]
    while todo:
        rows = todo.pop()
        parting = _split(prints[rows], reach, rng) if len(rows) > LEAF else None
        if parting is None:
            _compare(prints, rows, groups, reach)
            continue
        far = np.bitwise_count(prints[rows] ^ np.uint64(parting[0])).astype(np.int64)
        todo += [rows[far <= parting[1]], rows[far > parting[1] - reach]]


def _shard_links(reach: int):
    def run(shard: pa.Table) -> pa.Table:
        nodes = shard["fp"].to_numpy()
        groups = _Groups(nodes)
        _search(nodes.view(np.uint64), np.arange(len(nodes)), groups, reach, np.random.default_rng(SEED))
        roots = np.fromiter((groups.root(i) for i in range(len(nodes))), np.int64, len(nodes))
        own = roots != np.arange(len(nodes))
        return pa.table({"u": nodes[own], "v": nodes[roots[own]]})

    return run


def _routed(shard: np.ndarray | int, tree, prints: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shard, fp) columns of ``prints`` dealt out by ``tree``; children of a shard are numbered beyond all others."""
    for child, rows in _route(tree, prints, np.arange(len(prints)), reach):
        yield np.full(len(rows), ((shard + 1) << LEVELS) + child, np.int64), prints[rows].view(np.int64)


def _first_shards(nodes: DataFrame, n: int, reach: int, shard_rows: int) -> DataFrame:
    """(shard, fp) by a tree fitted on the driver."""
    depth = min(LEVELS, max(0, math.ceil(math.log2(max(1, n / shard_rows)))))
    wanted = SAMPLE_PER_SHARD << depth
    share = min(1.0, wanted / max(1, n))
    drawn = nodes.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else nodes
    sample = np.array([r[0] for r in drawn.select("fp").limit(2 * wanted).collect()], np.int64).view(np.uint64) if depth else np.zeros(0, np.uint64)
    tree = nodes.sparkSession.sparkContext.broadcast(_grow(np.sort(sample), depth, reach, np.random.default_rng(SEED), []))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, prints in _routed(0, tree.value, batch.column(0).to_numpy().view(np.uint64), reach):
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(prints)], names=["shard", "fp"])

    return nodes.select("fp").mapInArrow(route, "shard long, fp long")


def _part_again(routed: DataFrame, large: DataFrame, reach: int, shard_rows: int) -> DataFrame:
    """``routed`` with the shards of ``large`` (shard, n) parted by trees of their own, a bounded group of rows at a time."""
    depth = F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("n") / F.lit(float(shard_rows)))).cast("int"))
    large = large.select("shard", "n", depth.alias("depth"), F.ceil(F.col("n") / F.lit(ROUTED_ROWS)).cast("int").alias("parts"))
    share = F.lit(float(SAMPLE_PER_SHARD)) * F.pow(F.lit(2.0), "depth") / F.col("n")
    drawn = routed.join(large, "shard").where(F.pmod(F.xxhash64("fp", "shard"), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))

    def grow(sample: pa.Table) -> pa.Table:
        depth, prints = sample["depth"][0].as_py(), np.sort(sample["fp"].to_numpy().view(np.uint64))
        tree = _grow(prints, depth, reach, np.random.default_rng(SEED), [])
        return pa.table({"shard": sample["shard"][:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def route(rows: pa.Table, trees: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "fp": pa.array([], pa.int64())})
        shard, tree = rows["shard"][0].as_py(), pickle.loads(trees["tree"][0].as_py()) if trees.num_rows else 0
        made = list(_routed(shard, tree, rows["fp"].to_numpy().view(np.uint64), reach))
        return pa.table({"shard": np.concatenate([x for x, _ in made]), "fp": np.concatenate([x for _, x in made])})

    trees = cut(drawn.select("shard", "fp", "depth").groupBy("shard").applyInArrow(grow, "shard long, tree binary"), "trees")
    rows = routed.join(large.select("shard", "parts"), "shard").select("shard", "fp", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int").alias("part"))
    spread = trees.join(large, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    parted = rows.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(route, "shard long, fp long")
    return routed.join(large.select("shard"), "shard", "left_anti").unionByName(parted)


def links(prints: DataFrame, reach: int = REACH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (u, v) between the different fingerprints ``fp`` that differ in at most ``reach`` bits."""
    n = prints.count()
    routed, largest = _first_shards(prints, n, reach, shard_rows), n
    while n > LARGE * shard_rows:  # part the shards that are still large, whatever the total is
        routed = cut(routed, "routed")
        large = cut(routed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > LARGE * shard_rows), "large-shards")
        most = large.agg(F.max("n")).first()[0] or 0
        if not most or most > 0.8 * largest:  # small enough, or no tree parts them
            break
        routed, largest = _part_again(routed, large, reach, shard_rows), most
    return routed.groupBy("shard").applyInArrow(_shard_links(reach), "u long, v long")


def rooted(nodes: DataFrame, joined: DataFrame, key: str) -> DataFrame:
    """``nodes`` with ``root``, one key for all that ``joined`` (u, v) connects."""
    found = connected_components(joined).withColumnRenamed("node", key)
    return nodes.join(found, key, "left").withColumn("root", F.coalesce("component", key)).drop("component")


def name_rows(rows: DataFrame, joined: DataFrame, key: str) -> DataFrame:
    """``rows`` (doc_id, key, …) with ``component_id``, the smallest doc_id of all that ``joined`` connects. Rows of one doc_id
    are one document, so an id with several keys connects them."""
    nodes = cut(rows.groupBy(key).agg(F.min("doc_id").alias("doc")), "nodes")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("u"), F.max(key).alias("v")).where("u <> v").select("doc_id", "u")
    same = rows.join(several, "doc_id").select("u", F.col(key).alias("v"))
    found = rooted(nodes, joined.unionByName(same), key)
    least = found.groupBy("root").agg(F.min("doc").alias("component_id"))
    return rows.join(found.join(least, "root").select(key, "component_id"), key)


def drop_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``found`` (doc_id, raw, root): the one with the smallest doc_id, nulls last, and
    of several texts of that id the one with the least hash. Of rows that repeat an id and a text one stays."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "raw")
    found = cut(found.groupBy("root", "doc_id", "raw").agg(F.count("*").alias("n")).withColumn("place", place), "found")
    first = found.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("size")).where("size > 1")
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    several = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(SALTS)).cast("int")).join(spread, ["root", "salt"])
    gone = cut(several.where("place <> first").select("doc_id", "raw"), "gone")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    match = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("raw"))
    kept = packed.join(gone, match, "left_anti")
    twice = found.where("n > 1").select("doc_id", "raw")
    if twice.isEmpty():
        return kept.select("row.*")
    several = kept.join(twice, match, "left_semi").dropDuplicates(["id", "hash"])
    return kept.join(twice, match, "left_anti").unionByName(several).select("row.*")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, reach: int = REACH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fingerprint, component_id). Texts are read whole, however long.

    A null or blank text has fingerprint zero and is linked like any other. Rows of one doc_id count as one document, which
    links the groups of all its texts. A null doc_id cannot name a group: such rows take the group of their fingerprint, or
    null if nobody else is in it. An empty table gives an empty one; other columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    different = cut(prints.select("fp").distinct(), "different")
    named = name_rows(prints.select("doc_id", "fp"), links(different, reach, shard_rows), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, reach: int = REACH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of each group of ``docs``, columns unchanged (see ``drop_rows``). Here each text of a repeated id is a document of
    its own, so that no text goes that resembles none of those that stay."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    different = cut(prints.select("fp").distinct(), "different")
    found = rooted(different, links(different, reach, shard_rows), "fp")
    return drop_rows(docs, prints.join(found, "fp").select("doc_id", "raw", "root"), id_col, text_col)
