"""Quality by naive-Bayes support vectors (Wang and Manning, 2012).

Features are indicators of n-grams of words in lower case (n up to ``WORD_GRAMS``) and of word shapes (runs of lower-case,
upper-case letters, digits and other characters; n up to ``GRAMS``), of repeats of the word before, and of repeated lines,
hashed to ``1 << BITS`` places. Class log-count
ratios scale the indicators and a linear hinge-loss model is fitted to them by dual coordinate descent; a logistic fit on
examples the model has not seen turns margins into probabilities. At most about ``TRAIN_ROWS`` labelled rows are learnt from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold
from .labelled import training_rows
from .linear import dual_coordinate_descent, logistic, sigmoid

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
TRAIN_ROWS = 6000
BITS = 18
GRAMS = 4
WORD_GRAMS = 1
CACHE = 400_000

_RUNS = ((re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"[A-Z]{2,}"), "B"), (re.compile(r"[A-Z]"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"([^aAB0])\1+"), r"\1\1"))


class Shapes(dict):
    """Word -> hash of its shape, filled on demand and emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        shape = word if word.isascii() else "".join(c if c.isascii() else "Z" if c.isupper() else "z" if c.isalpha() else c for c in word)
        for pattern, to in _RUNS:
            shape = pattern.sub(to, shape)
        value = self[word] = xxhash.xxh64_intdigest(shape)
        return value


class Words(dict):
    """Word -> hash of its lower-case form, filled on demand and emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.lower(), 1)
        return value


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _grams(marks: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the n-grams of ``marks``, n up to ``most``."""
    parts, gram = [], marks
    for n in range(1, min(most, len(marks)) + 1):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x100000001B3) + marks[n - 1 :]
        mixed = (gram ^ (gram >> np.uint64(29)) ^ np.uint64(n)) * _MIX
        parts.append(mixed >> np.uint64(64 - BITS))
    return parts


class Features:
    """Text -> sorted places of its features. One for each task, as it remembers words."""

    def __init__(self, word_grams: int = WORD_GRAMS):
        self.shapes, self.words, self.word_grams = Shapes(), Words(), word_grams

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        extra = [xxhash.xxh64_intdigest(f"words {len(words).bit_length()}")]
        if not words:
            return np.array(extra, np.uint64) >> np.uint64(64 - BITS)
        marks = np.fromiter(map(self.shapes.__getitem__, words), np.uint64, len(words))
        same = np.fromiter((a == b for a, b in zip(words[1:], words, strict=False)), bool, len(words) - 1)
        marks[1:][same] ^= _MIX
        lines = [x for x in text.split("\n") if x]
        repeats = len(lines) - len(set(lines))
        extra += [xxhash.xxh64_intdigest(f"repeated lines {10 * repeats // len(lines)}")] if repeats else []
        parts = [np.array(extra, np.uint64) >> np.uint64(64 - BITS), *_grams(marks, GRAMS)]
        if self.word_grams:
            parts += _grams(np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words)), self.word_grams)
        return np.unique(np.concatenate(parts)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # of each place: ratio times support-vector weight
    bias: float
    slope: float
    intercept: float

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum() / np.sqrt(max(1, len(places))) + self.bias)

    def score(self, places: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(places) + self.intercept))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Logarithm of the classes' ratio of smoothed, normalised counts of each place."""
    counts = {y: np.ones(1 << BITS) for y in (0, 1)}
    for places, y in zip(rows, labels, strict=True):
        counts[int(y)][places] += 1
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def _fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    ratio = log_count_ratio(rows, labels)
    values = [ratio[p] / np.sqrt(max(1, len(p))) for p in rows]
    fitted = dual_coordinate_descent(rows, values, np.where(labels > 0, 1, -1), 1 << BITS)
    return ratio * fitted[:-1], float(fitted[-1])


def fit(x: list[np.ndarray], y: np.ndarray) -> Model:
    """A model of examples, given as sorted places, in an order that does not depend on theirs."""
    if len(set(y.tolist())) < 2:
        rate = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    order = sorted(range(len(y)), key=lambda i: (xxhash.xxh64_intdigest(x[i].tobytes()), y[i]))
    x, y = [x[i] for i in order], y[order]
    margins = np.zeros(len(y))
    for part in range(3):  # margins of examples that the model has not seen
        out = np.arange(len(y)) % 3 == part
        weights, bias = _fit([x[i] for i in np.flatnonzero(~out)], y[~out]) if len(set(y[~out].tolist())) == 2 else (np.zeros(1 << BITS), 0.0)
        for i in np.flatnonzero(out):
            margins[i] = weights[x[i]].sum() / np.sqrt(max(1, len(x[i]))) + bias
    beta = logistic(margins[:, None], y.astype(float))
    weights, bias = _fit(x, y)
    return Model(weights, bias, max(0.0, float(beta[0])), float(beta[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Model:
    """A model of the labelled rows that may be learnt from: see ``labelled.training_rows`` for nulls, repeats and the bound.

    Examples with the same features and label count once, so copies of a text add nothing. A null or empty text is an example
    too, long ones are read whole. With one class only every text scores its share, 0.5 without rows.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            places = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(places, pa.list_(pa.int64()))], names=["label", "places"])

    sample = training_rows(docs, labels, "quality", FOLDS, HELD_OUT, most, id_col, text_col)
    rows = cut(sample.mapInArrow(extract, "label int, places array<bigint>").dropDuplicates(), "quality-train").toArrow()  # of the bounded sample
    x = [np.array(p.values, np.int64) if p.values is not None else np.zeros(0, np.int64) for p in rows["places"]]
    return fit(x, rows["label"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted). Null texts score as empty ones do.
    Rows that repeat an id are scored each; long texts are read whole; an empty table gives an empty one; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            values = [sent.value.score(features(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array([int(v >= THRESHOLD) for v in values], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
