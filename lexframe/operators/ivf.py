"""An inverted file over vectors: cells around centroids, searched exactly.

Centroids are fitted on a bounded sample by spherical k-means; every vector is assigned to its nearest one and lies in that cell's
folder. A cell's radius is the greatest distance of a vector from its centroid. A first look at the nearest cells gives each query k vectors, and
so a bound; by the triangle inequality a cell further away than bound and radius allow holds nothing better, and is not opened. So the result is
that of a search over all vectors, ties included, whatever the centroids are: they decide the cost only.

What goes to all executors are the centroids (at most ``MOST_CELLS``), a block of queries and which cells it may still need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dense import BLOCK_FLOATS, _matrix
from .lexical import top_k

SAMPLE = 20_000
MOST_CELLS = 4096
ROWS_PER_CELL = 2_000
ROUNDS = 10
SLACK = 2e-6  # scores are compared when rounded to six decimals


def fit(vectors: DataFrame, cells: int, vector_col: str, sample: int = SAMPLE, seed: int = 5) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells, from about ``sample`` vectors drawn by hash; one at least."""
    usable = vectors.where(F.col(vector_col).isNotNull()).select(vector_col)
    n = usable.count()
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64(vector_col), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    drawn = _matrix(usable.limit(2 * sample).toArrow()[vector_col].combine_chunks())  # of the bounded sample
    if not len(drawn):
        return np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    centroids = drawn[rng.permutation(len(drawn))[: min(cells, len(drawn))]]
    for _ in range(ROUNDS):
        owner = np.argmax(drawn @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, drawn)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit rows."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


@dataclass
class Report:
    """Cells opened by a search, of all, and vectors compared with a query, of all pairs; summed over blocks of queries."""

    cells: int = 0
    of_cells: int = 0
    compared: int = 0
    of_compared: int = 0


class Index:
    """Vectors under ``path`` by cell. ``radius`` and ``count`` are those of the cells."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, id_col: str, vector_col: str):
        self.rows, self.centroids, self.id_col, self.vector_col = rows, centroids, id_col, vector_col
        found = rows.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()  # a row a cell
        self.radius, self.count = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64)
        for r in found:
            self.radius[r["cell"]], self.count[r["cell"]] = r["far"], r["n"]

    def search(self, queries: DataFrame, k: int, query_col: str = "query_id", query_vector: str = "query_vector", report: Report | None = None) -> DataFrame:
        """Exact top k of each query by cosine: (query, id, score, rank), ties by id. Null vectors are neither found nor looked for."""
        usable = queries.where(F.col(query_vector).isNotNull()).select(query_col, query_vector)
        size = usable.agg(F.sum(F.size(query_vector))).first()[0] or 0
        blocks = max(1, -(-size // BLOCK_FLOATS))
        parts = []
        for block in range(blocks):
            asked = usable.where(F.pmod(F.xxhash64(query_col), F.lit(blocks)) == block).toArrow()
            parts.append(self._block(asked[query_col].combine_chunks(), _matrix(asked[query_vector].combine_chunks()), k, usable.schema[query_col].dataType.simpleString(), query_col, report))
        return top_k(reduce(DataFrame.unionByName, parts), query_col, self.id_col, k)

    def _block(self, names: pa.Array, asked: np.ndarray, k: int, kind: str, query_col: str, report: Report | None) -> DataFrame:
        held = np.flatnonzero(self.count)
        need = np.zeros((len(names), len(self.centroids)), bool)
        if len(names) and len(held):
            away = _distances(asked, self.centroids)
            order = held[np.argsort(away[:, held], axis=1, kind="stable")]
            enough = np.cumsum(self.count[order], axis=1)
            first = np.minimum((enough < k).sum(axis=1), len(held) - 1)  # the cells that hold k vectors at least
            np.put_along_axis(need, order, np.arange(len(held)) <= first[:, None], axis=1)
            best = top_k(self._scored(names, asked, need, k, kind, query_col), query_col, self.id_col, k)
            least = {r[0]: r[1] for r in best.where(F.col("rank") == k).select(query_col, "score").collect()}  # a row a query of the block
            bound = np.array([least.get(n, -2.0) for n in names.to_pylist()])
            nearest = np.maximum(0.0, away - np.maximum(self.radius, 0.0))
            need |= (1.0 - nearest**2 / 2.0 >= bound[:, None] - SLACK) & (self.count > 0)
        if report is not None:
            opened = need.any(axis=0)
            report.cells += int(opened.sum())
            report.of_cells += len(held)
            report.compared += int((need @ self.count).sum())
            report.of_compared += int(self.count.sum()) * len(names)
        return self._scored(names, asked, need, k, kind, query_col)

    def _scored(self, names: pa.Array, asked: np.ndarray, need: np.ndarray, k: int, kind: str, query_col: str) -> DataFrame:
        """(query, id, score) of at most k vectors a query, cell and batch, in the cells that ``need`` (query by cell) names."""
        opened = [int(c) for c in np.flatnonzero(need.any(axis=0))]
        sent = self.rows.sparkSession.sparkContext.broadcast((names, asked, need))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked, need = sent.value
            for batch in batches:
                cells, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy(zero_copy_only=False)
                for cell in np.unique(cells).tolist():
                    own, who = np.flatnonzero(cells == cell), np.flatnonzero(need[:, cell])
                    if not len(who):
                        continue
                    scores = np.round(asked[who] @ _matrix(batch.column(1).take(pa.array(own))).T, 9)
                    take, order = min(k, len(own)), np.argsort(ids[own], kind="stable")
                    best = order[np.argsort(-np.round(scores, 6)[:, order], axis=1, kind="stable")[:, :take]]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(who, take))), batch.column(0).take(pa.array(own[best].ravel())), pa.array(np.take_along_axis(scores, best, 1).ravel())], names=[query_col, id_col, "score"])

        id_col, own = self.id_col, self.rows.schema[self.id_col].dataType.simpleString()
        rows = self.rows.where(F.col("cell").isin(opened)) if opened else self.rows.limit(0)
        return rows.select(id_col, self.vector_col, "cell").mapInArrow(run, f"{query_col} {kind}, {id_col} {own}, score double")


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None) -> Index:
    """Writes the index of ``vectors`` to the new folder ``path``. All vectors must have one length; null ones are left out."""
    spark: SparkSession = vectors.sparkSession
    usable = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    n = usable.count()
    centroids = fit(usable, cells or max(1, min(MOST_CELLS, n // ROWS_PER_CELL, int(n**0.5))), vector_col)
    sent = spark.sparkContext.broadcast(centroids)
    schema = f"{id_col} {usable.schema[id_col].dataType.simpleString()}, {vector_col} {usable.schema[vector_col].dataType.simpleString()}, far double, cell int"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _distances(_matrix(batch.column(1)), sent.value)
            cell = np.argmin(away, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away[np.arange(len(cell)), cell] + 1e-9), pa.array(cell.astype(np.int32))], names=[id_col, vector_col, "far", "cell"])

    dealt = usable.mapInArrow(assign, schema) if n else spark.createDataFrame([], schema)
    # A large cell is spread over several tasks, each of which writes a file of it.
    spread = F.pmod(F.xxhash64(id_col), F.lit(max(1, n // max(1, len(centroids)) // ROWS_PER_CELL // 8 + 1)))
    dealt.repartition("cell", spread).write.partitionBy("cell").parquet(path)
    return Index(spark.read.schema(schema).parquet(path), centroids, id_col, vector_col)
