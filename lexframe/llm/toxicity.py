"""Toxic passages as maximum-scoring segments of token log-odds.

Learning. Tokens are maximal letter runs in lower case; a token's features are itself and its first 5, 6 and 7 letters,
so that inflected forms share evidence. Document frequencies of the features in toxic and in other documents give
log-odds with an informative Dirichlet prior (Monroe et al., 2008: the prior of a feature is in proportion to its overall
frequency) and their variance. Copies would count one document's rare words many times, so of documents that share
either of two min-hashes of their 5-word shingles one is counted. Features that favour toxic text significantly form the
lexicon, each with the lower end of its interval as score; every other token scores a small negative drift.

Scoring. A linear scan (Ruzzo and Tompa, 1999) finds all maximal-scoring segments. A segment's expected number in clean
text of n tokens is K n exp(-lambda S) (Karlin and Altschul, 1990); lambda solves the moment equation on the clean training
documents and K follows from how often their segments reach a score. Significant segments are the passages; a document's
evidence is the sum of -ln(expected number) over them, and a logistic fit turns evidence into a probability.

Bounds: at most about ``TRAIN_ROWS`` labelled documents are learnt from, whatever the input, and the lexicon has no more features
than these. The constants of ``Settings`` are chosen by cross-validation inside the folds that may be learnt from.
"""

from __future__ import annotations

import math
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
from .linear import logistic, sigmoid

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
TRAIN_ROWS = 8000
CACHE = 400_000


@dataclass(frozen=True)
class Settings:
    """``prefixes``: lengths of the beginnings that are features. ``least_docs``: toxic documents that a feature must be in.
    ``least_z``: standard errors by which its log-odds exceed zero. ``least_score``: least lexicon score. ``prior``: weight of the
    Dirichlet prior. ``drift``: what a token outside the lexicon loses. ``significant``: greatest expected number of a passage."""

    prefixes: tuple[int, ...] = (5, 6, 7)
    least_docs: int = 5
    least_z: float = 3.5
    least_score: float = 0.5
    prior: float = 200.0
    drift: float = 0.4
    significant: float = 0.3


_TOKEN = re.compile(r"[^\W\d_]+")


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def features_of(token: str, prefixes: tuple[int, ...]) -> list[str]:
    return ["=" + token, *(token[:k] for k in prefixes if len(token) >= k)]


class Scores(dict):
    """Token -> lexicon score, zero outside it; filled on demand and emptied when it grows too large."""

    def __init__(self, lexicon: dict[str, float], prefixes: tuple[int, ...] = Settings.prefixes):
        super().__init__()
        self.lexicon, self.prefixes = lexicon, prefixes

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = max(0.0, *(self.lexicon.get(f, 0.0) for f in features_of(token, self.prefixes)))
        self[token] = value
        return value


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (first token, last token, score); ``hits`` are the (place, score) with a positive
    score in order, all other places score -drift. Each segment keeps the number of the nearest one before it whose left sum
    is less than its own: later searches follow these links, which makes the scan linear."""
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before it, sum up to its end, link
    total, last = 0.0, -1
    for place, score in hits:
        total -= drift * (place - last - 1)
        last = place
        first, left, right = place, total, total + score
        total = right
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= right:
                stack.append((first, place, left, right, k))
                break
            first, _, left, _, link = stack[k]
            del stack[k:]
            k = link
    return [(a, b, right - left) for a, b, left, right, _ in stack]


@dataclass
class Model:
    lexicon: dict[str, float]
    rate: float  # lambda
    factor: float  # K
    slope: float
    intercept: float
    settings: Settings = Settings()

    def expected(self, n: int, score: float) -> float:
        """Logarithm of the number of segments of this score that clean text of n tokens is expected to hold."""
        return math.log(self.factor * max(1, n)) - self.rate * score

    def passages(self, tokens: list[str], scores: Scores) -> list[tuple[int, int, float, float]]:
        """Significant segments: first token, last token, score, ln of the expected number."""
        hits = [(i, s) for i, s in enumerate(map(scores.__getitem__, tokens)) if s]
        if not hits:
            return []
        found = ((a, b, s, self.expected(len(tokens), s)) for a, b, s in segments(hits, self.settings.drift))
        return [x for x in found if x[3] < math.log(self.settings.significant)]

    def score(self, passages: list[tuple[int, int, float, float]]) -> float:
        return float(sigmoid(self.slope * math.log1p(sum(-x[3] for x in passages)) + self.intercept))


def _minhashes(tokens: list[str]) -> tuple[int, int]:
    joined = [" ".join(tokens[i : i + 5]).encode() for i in range(max(1, len(tokens) - 4))]
    prints = np.array([xxhash.xxh64_intdigest(x) for x in joined], np.uint64)
    return int(prints.min().astype(np.int64)), int((prints * np.uint64(0x9E3779B97F4A7C15)).min().astype(np.int64))


def _featured(prefixes: tuple[int, ...]):
    """Two min-hashes and the features of each (text, label) row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens = [tokens_of(t) for t in part.column(0).to_pylist()]
                first, second = zip(*map(_minhashes, tokens), strict=True)
                features = [sorted({f for t in set(x) for f in features_of(t, prefixes)}) for x in tokens]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(features, pa.list_(pa.string()))], names=["label", "first", "second", "features"])

    return run


def _lexicon(sample: DataFrame, settings: Settings) -> dict[str, float]:
    seen = cut(sample.mapInArrow(_featured(settings.prefixes), "label int, first long, second long, features array<string>"), "toxicity-train")
    # Toxic copies before others, so that which copy is counted does not depend on the order of rows.
    kept = seen.groupBy("first").agg(F.max(F.struct("label", "second", "features")).alias("d")).select("d.*")
    kept = cut(kept.groupBy("second").agg(F.max(F.struct("label", "features")).alias("d")).select("d.*"), "toxicity-kept")
    row = kept.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    toxic, clean = float(row[0]), float(row[1] - row[0])
    if not toxic or not clean:
        return {}
    counts = kept.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.sum("label").alias("t"), F.count("*").alias("n")).where(F.col("t") >= settings.least_docs)
    share = F.col("n") / F.lit(toxic + clean)
    prior = share * settings.prior
    odds = lambda y, n: F.log((y + prior) / (n + settings.prior - y - prior))
    other = F.col("n") - F.col("t")
    scored = counts.withColumn("d", odds(F.col("t"), F.lit(toxic)) - odds(other, F.lit(clean))).withColumn("e", F.sqrt(1 / (F.col("t") + prior) + 1 / (other + prior)))
    best = scored.where(F.col("d") >= settings.least_z * F.col("e")).withColumn("s", F.col("d") - 1.96 * F.col("e")).where(F.col("s") > settings.least_score)
    return {r["f"]: r["s"] for r in best.orderBy("f").select("f", "s").collect()}  # of the bounded sample


def _rate(counts: dict[float, int], drift: float) -> float:
    """lambda > 0 with sum p(s) exp(lambda s) = 1 over the scores of clean tokens."""
    total = sum(counts.values())

    def excess(rate: float) -> float:
        return sum(n / total * math.exp(min(700.0, rate * (s if s > 0 else -drift))) for s, n in counts.items()) - 1

    low, high = 1e-6, 1e-6
    while excess(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 0.05)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS, settings: Settings | None = None) -> Model:
    """A model of the labelled rows that may be learnt from: see ``labelled.training_rows`` for nulls, repeats and the bound.

    Without toxic or without clean rows every text scores the share of toxic ones, none if there are no rows at all.
    """
    return fit(cut(training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, most, id_col, text_col), "toxicity-sample"), settings or Settings())


def fit(sample: DataFrame, settings: Settings) -> Model:
    """``train`` on a bounded sample of (text, label)."""
    lexicon = _lexicon(sample, settings)
    if not lexicon:
        rate = sample.agg(F.avg("label")).first()[0] or 0.0
        return Model({}, 1.0, 1.0, 0.0, math.log((rate + 1e-3) / (1 - rate + 1e-3)), settings)
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(sent.value, settings.prefixes)
        for batch in batches:
            ns, hit, found = [], [], []
            for text in batch.column(0):
                tokens = tokens_of(text.as_py())
                hits = [(i, s) for i, s in enumerate(map(scores.__getitem__, tokens)) if s]
                ns.append(len(tokens))
                hit.append([round(s, 1) for _, s in hits])
                found.append([s for _, _, s in segments(hits, settings.drift)])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ns, pa.int64()), pa.array(hit, pa.list_(pa.float64())), pa.array(found, pa.list_(pa.float64()))], names=["label", "n", "hits", "segments"])

    seen = cut(sample.mapInArrow(observe, "label int, n long, hits array<double>, segments array<double>"), "toxicity-seen")
    clean = seen.where("label = 0")
    levels = clean.select(F.explode("hits").alias("s")).groupBy("s").count().collect()  # one decimal: a few hundred levels
    tokens = clean.agg(F.sum("n")).first()[0] or 0
    top = max(lexicon.values())
    counts = {r["s"]: r["count"] for r in levels}
    counts[top] = counts.get(top, 0) + 1  # a token more than was seen, or lambda has no solution
    counts[0.0] = max(1, tokens - sum(counts.values()))
    rate = _rate(counts, settings.drift)
    from_score = min(lexicon.values())
    reached = clean.agg(F.sum(F.size(F.filter("segments", lambda s: s >= from_score)))).first()[0] or 0
    factor = min(10.0, max(1e-4, (reached + 0.5) / (max(1, tokens) * math.exp(-rate * from_score))))
    model = Model(lexicon, rate, factor, 0.0, 0.0, settings)
    evidence = F.aggregate(F.transform("segments", lambda s: F.lit(rate) * s - F.log(F.lit(factor) * F.greatest(F.col("n"), F.lit(1)))), F.lit(0.0), lambda a, x: a + F.when(x > -math.log(settings.significant), x).otherwise(0.0))
    rows = np.array([[r[0], r[1]] for r in seen.select("label", F.log1p(evidence)).collect()], float)  # of the bounded sample
    beta = logistic(rows[:, 1:], rows[:, 0])
    model.slope, model.intercept = max(0.0, float(beta[0])), float(beta[1])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted, passages). A passage has its first and last token,
    score and ln of its expected number in clean text. Null and empty texts have none and get the score of clean text. Rows that
    repeat an id are scored each; an empty table gives an empty one; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scores = Scores(model.lexicon, model.settings.prefixes)
        for batch in batches:
            found = [model.passages(tokens_of(t.as_py()), scores) for t in batch.column(2)]
            values = [model.score(x) for x in found]
            passages = [[dict(zip(("first", "last", "score", "log_expected"), p, strict=True)) for p in x] for x in found]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("log_expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array([int(v >= THRESHOLD) for v in values], pa.int32()), pa.array(passages, kind)], names=["doc_id", "held_out", "score", "predicted", "passages"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, passages array<struct<first:int,last:int,score:double,log_expected:double>>")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns unchanged. Null and empty texts hold no passage: they stay unless
    the model rejects clean text too."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(sent.value.lexicon, sent.value.settings.prefixes)
        for batch in batches:
            keep = [sent.value.score(sent.value.passages(tokens_of(t.as_py()), scores)) < THRESHOLD for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
