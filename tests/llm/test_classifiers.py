import math
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from lexframe.llm import linear, quality, toxicity
from lexframe.llm.labelled import training_rows

from .inputs import frame

INSULTS = ["zoquete", "mentecato", "patán"]


def corpus(n=600):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        ws = ["".join(rng.choice(["ta", "lo", "mi", "re", "su"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        toxic, junk = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                ws.insert(rng.randrange(len(ws)), rng.choice(INSULTS) + rng.choice(["", "s", "azo"]))
        if junk:
            ws = [w.upper() + "!!" for w in ws]
        docs.append((i, " ".join(ws), "en", "s", 0, "x", 0.1, 1))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return frame(spark, docs).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def accuracy(rows, labels, column):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [r for r in rows if r["held_out"]]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert accuracy(rows, labels, "quality") > 0.97


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert accuracy(rows, labels, "toxic") > 0.97
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if not r["predicted"])
    for r in rows[:50]:
        tokens = toxicity.tokens_of(next(d[1] for d in corpus()[0] if d[0] == r["doc_id"]))
        assert all(any(tokens[i].startswith(w[:5]) for i in range(p["first"], p["last"] + 1) for w in INSULTS) for p in r["passages"])


def test_held_out_labels_do_not_matter(spark, tables):
    """Flipping the labels of the held-out fold changes no score."""
    docs, labels = tables
    for module, folds, out, column in ((quality, 5, 0, "quality"), (toxicity, 4, 2, "toxic")):
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == out
        flipped = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
        score = lambda t, m=module: {r["doc_id"]: r["score"] for r in m.score(docs, m.train(docs, t)).collect()}
        assert score(labels) == score(flipped)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_and_missing_labels(spark, module):
    rows = module.score(frame(spark), module.train(frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == frame(spark).count()
    assert module is quality or not any(r["predicted"] for r in rows)  # without labels nothing is toxic
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None), (4, 0, 1), (5, 1, 0), (7, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert module.score(frame(spark), module.train(frame(spark), odd)).count() == len(rows)
    assert module.score(frame(spark, []), module.train(frame(spark, []), odd)).count() == 0


def test_segments_against_all_subsequences():
    """A maximal segment has every proper prefix and suffix positive and lies in no larger such one."""
    rng = random.Random(6)
    for _ in range(200):
        scores = [rng.choice([-1.0, -1.0, -1.0, 0.75, 2.5]) for _ in range(rng.randrange(1, 14))]
        good = []
        for a in range(len(scores)):
            for b in range(a, len(scores)):
                part = scores[a : b + 1]
                if all(sum(part[:k]) > 0 for k in range(1, len(part) + 1)) and all(sum(part[k:]) > 0 for k in range(len(part))):
                    good.append((a, b))
        maximal = [(a, b) for a, b in good if not any((c <= a and b <= d) and (c, d) != (a, b) for c, d in good)]
        found = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], 1.0)
        assert sorted((a, b) for a, b, _ in found) == sorted(maximal)
        assert all(math.isclose(s, sum(scores[a : b + 1])) for a, b, s in found)


def test_long_texts_are_scanned_in_linear_time():
    """Rising left sums keep every segment on the list; a scan back over all of them would take minutes."""
    import time

    began = time.perf_counter()
    found = toxicity.segments([(100 * i, 1.0) for i in range(300_000)], 0.4)
    falling = toxicity.segments([(i, 1.0 + i % 2) for i in range(0, 300_000, 3)], 0.5)
    assert len(found) == 300_000 and falling and time.perf_counter() - began < 5


def plain_toxicity(rows, settings):
    """Lexicon, lambda, K and scoring computed again, row by row."""
    grams = lambda t: {"=" + t, *(t[:k] for k in settings.prefixes if len(t) >= k)}
    own = [(toxicity._minhashes(toxicity.tokens_of(t)), y, sorted({f for w in set(toxicity.tokens_of(t)) for f in grams(w)})) for t, y in rows]
    first = {h[0]: max((y, g[1], f) for g, y, f in own if g[0] == h[0]) for h, _, _ in own}
    second = {h: max((y, f) for y, g, f in first.values() if g == h) for _, h, _ in first.values()}
    kept = {h: (h, y, f) for h, (y, f) in second.items()}
    n = [sum(y == c for _, y, _ in kept.values()) for c in (0, 1)]
    count = {}
    for _, y, features in kept.values():
        for f in features:
            count.setdefault(f, [0, 0])[y] += 1
    lexicon = {}
    for f, (clean, toxic) in count.items():
        prior = (clean + toxic) / sum(n) * settings.prior
        odds = lambda c, of, prior=prior: math.log((c + prior) / (of + settings.prior - c - prior))
        d, e = odds(toxic, n[1]) - odds(clean, n[0]), math.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
        if toxic >= settings.least_docs and d >= settings.least_z * e and d - 1.96 * e > settings.least_score:
            lexicon[f] = d - 1.96 * e
    value = lambda t: max([lexicon.get(f, 0.0) for f in grams(t)] + [0.0])
    scored = [([value(t) for t in toxicity.tokens_of(text)], y) for text, y in rows]
    found = [toxicity.segments([(i, s) for i, s in enumerate(v) if s], settings.drift) for v, _ in scored]
    total, hits = sum(len(v) for v, y in scored if not y), {}
    for v, y in scored:
        for s in v if not y else ():
            if s:
                hits[round(s, 1)] = hits.get(round(s, 1), 0) + 1
    top, least = max(lexicon.values()), min(lexicon.values())
    hits[top] = hits.get(top, 0) + 1
    hits[0.0] = max(1, total - sum(hits.values()))
    rate = toxicity._rate(hits, settings.drift)
    reached = sum(s >= least for x, (_, y) in zip(found, scored, strict=True) if not y for _, _, s in x)
    factor = min(10.0, max(1e-4, (reached + 0.5) / (max(1, total) * math.exp(-rate * least))))
    evidence = [math.log1p(sum(e for e in (rate * s - math.log(factor * max(1, len(v))) for _, _, s in x) if e > -math.log(settings.significant))) for x, (v, _) in zip(found, scored, strict=True)]
    beta = linear.logistic(np.array(evidence)[:, None], np.array([y for _, y in scored], float))
    return lexicon, rate, factor, [float(linear.sigmoid(max(0.0, beta[0]) * e + beta[1])) for e in evidence]


def test_toxicity_against_plain(spark, tables):
    docs, labels = tables
    rows = [(r["text"], r["toxic"]) for r in docs.join(labels, "doc_id").where("doc_id < 200").select("text", "toxic").collect()]
    settings = toxicity.Settings(least_score=0.2, drift=0.3)
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"), settings)
    lexicon, rate, factor, scores = plain_toxicity(rows, settings)
    assert model.lexicon == pytest.approx(lexicon) and lexicon
    assert (model.rate, model.factor) == (pytest.approx(rate), pytest.approx(factor))
    held = toxicity.Scores(model.lexicon, settings.prefixes)
    assert [model.score(model.passages(toxicity.tokens_of(t), held)) for t, _ in rows] == pytest.approx(scores, abs=1e-6)


def test_quality_ratios_and_objective_against_plain():
    docs, labels = corpus(120)
    features, y = quality.Features(), np.array([q for _, q, _ in labels])
    x = [features(d[1]) for d in docs]
    ratio = quality.log_count_ratio(x, y)
    p = [1 + sum(place in own for own, c in zip([set(v.tolist()) for v in x], y, strict=True) if c == k) for k in (1, 0) for place in (int(x[0][0]), int(x[5][-1]))]
    whole = [(1 << quality.BITS) + sum(len(v) for v, c in zip(x, y, strict=True) if c == k) for k in (1, 0)]
    assert [ratio[int(x[0][0])], ratio[int(x[5][-1])]] == pytest.approx([math.log(p[0] / whole[0] / (p[2] / whole[1])), math.log(p[1] / whole[0] / (p[3] / whole[1]))])

    values = [ratio[v] / np.sqrt(len(v)) for v in x]
    sign = np.where(y > 0, 1, -1)
    cost = {t: len(y) / (2 * (sign == t).sum()) for t in (-1, 1)}

    def objective(w):
        return 0.5 * w @ w + sum(cost[t] * max(0.0, 1 - t * (w[v] @ a + w[-1])) for v, a, t in zip(x, values, sign, strict=True))

    best = linear.dual_coordinate_descent(x, values, sign, 1 << quality.BITS, epochs=200)
    rng, used = np.random.default_rng(1), np.unique(np.concatenate(x))
    for scale in (1e-1, 1e-2, 1e-3):
        for _ in range(8):
            other = best.copy()
            other[used] += rng.normal(size=len(used)) * scale
            other[-1] += rng.normal() * scale
            assert objective(other) > objective(best) * (1 - 1e-2)
    assert objective(best * 0.98) > objective(best) * (1 - 1e-2) and objective(best * 1.02) > objective(best) * (1 - 1e-2)


def plain_quality(rows):
    """Ratios, three-way margins, calibration and scores computed again from texts and labels."""
    features = quality.Features()
    examples = sorted({(tuple(features(t).tolist()), y) for t, y in rows}, key=lambda e: (quality.xxhash.xxh64_intdigest(np.array(e[0], np.int64).tobytes()), e[1]))

    def fitted(part):
        count = {c: {} for c in (0, 1)}
        for places, y in part:
            for p in places:
                count[y][p] = count[y].get(p, 0) + 1
        whole = {c: (1 << quality.BITS) + sum(count[c].values()) for c in (0, 1)}
        ratio = lambda p: math.log((1 + count[1].get(p, 0)) / whole[1]) - math.log((1 + count[0].get(p, 0)) / whole[0])
        values = [np.array([ratio(p) for p in places]) / math.sqrt(len(places)) for places, _ in part]
        w = linear.dual_coordinate_descent([np.array(p) for p, _ in part], values, np.array([1 if y else -1 for _, y in part]), 1 << quality.BITS)
        return lambda places: sum(ratio(p) * w[p] for p in places) / math.sqrt(len(places)) + w[-1]

    margins = np.zeros(len(examples))
    for k in range(3):
        margin = fitted([e for i, e in enumerate(examples) if i % 3 != k])
        for i in range(k, len(examples), 3):
            margins[i] = margin(examples[i][0])
    beta = linear.logistic(margins[:, None], np.array([float(y) for _, y in examples]))
    margin = fitted(examples)
    return [float(linear.sigmoid(max(0.0, beta[0]) * margin(tuple(features(t).tolist())) + beta[1])) for t, _ in rows]


def test_quality_scores_against_plain(spark, tables):
    """What the query runs, train and score, against the same model computed from texts and labels."""
    docs, labels = tables
    docs = docs.where("doc_id < 150")
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    rows = [(r["doc_id"], r["text"], r["quality"]) for r in docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()]
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    expected = dict(zip([r[0] for r in learnt], plain_quality([(t, y) for _, t, y in learnt]), strict=True))
    assert {i: found[i] for i in expected} == pytest.approx(expected, abs=1e-6)


def test_training_rows_are_bounded_and_may_have_any_columns(spark):
    """20,000 rows of one id, equal or not, and columns with the names of results."""
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    docs = spark.range(20_000).selectExpr("7L as doc_id", "'the same' as text", "5 as label", "6 as id", "'z' as h1")
    assert training_rows(docs, labels, "quality", 5, 0, 100).collect() == [("the same", 1)]
    varied = docs.withColumn("text", F.concat(F.lit("text "), F.monotonically_increasing_id().cast("string")))
    rows = training_rows(varied, labels, "quality", 5, 0, 100).collect()
    assert 50 < len(rows) < 160 and {r["label"] for r in rows} == {1}


def test_lambda_solves_its_equation():
    rate = toxicity._rate({0.0: 9900, 2.0: 90, 4.0: 10}, 0.5)
    assert 0.99 * math.exp(-0.5 * rate) + 0.009 * math.exp(2 * rate) + 0.001 * math.exp(4 * rate) == pytest.approx(1.0, abs=1e-9)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(200) < 0.3, 1, -1)
    rows = [np.array([0, 1, 2 + i]) for i in range(200)]
    values = [np.array([float(t), 0.3 * rng.normal(), 0.1]) for t in y]
    w = linear.dual_coordinate_descent(rows, values, y, 202)
    assert all(np.sign(w[r] @ v + w[-1]) == t for r, v, t in zip(rows, values, y, strict=True))
