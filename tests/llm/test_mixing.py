import math

import pytest

from lexframe.llm import mixing

from .inputs import awkward, frame

SIZES = {"big": 3000, "mid": 300, "low": 30}


def docs(spark):
    rows, i = [], 0
    for source, n in SIZES.items():
        for k in range(n):
            rows.append((i, "a " * (k % 9 + 1), None, source, None, None, None, None))
            i += 1
    return frame(spark, rows)


def totals():
    return {s: sum(k % 9 + 1 for k in range(n)) for s, n in SIZES.items()}


def entropy(a):
    t = totals()
    n = sum(t.values())
    w = {s: (v / n) ** a for s, v in t.items()}
    z = sum(w.values())
    return -sum(x / z * math.log(x / z) for x in w.values())


def by_source(mixed):
    out = {}
    for r in mixed.collect():
        s = out.setdefault(r["source"], {"tokens": 0, "used": 0, "weight": r["weight"], "repetition": r["repetition"], "copies": set(), "share": r["share"]})
        s["tokens"] += r["n_tokens"]
        s["used"] += r["n_tokens"] * r["copies"]
        s["copies"].add(r["copies"])
    return out


def test_target_entropy(spark):
    found = by_source(mixing.mix(docs(spark), target_entropy=0.8, budget_tokens="corpus", block_rows=64))
    share = {s: v / sum(totals().values()) for s, v in totals().items()}
    exponent = math.log(found["big"]["weight"] / found["low"]["weight"]) / math.log(share["big"] / share["low"])
    assert entropy(exponent) == pytest.approx(0.8 * math.log(3), abs=1e-6)
    for s, v in found.items():
        assert v["tokens"] == totals()[s] and v["used"] == pytest.approx(v["weight"] * sum(totals().values()), abs=9.1)
        assert len(v["copies"]) <= 2 and max(v["copies"]) - min(v["copies"]) <= 1


def test_repetition_limit(spark):
    found = by_source(mixing.mix(docs(spark), max_repetition=2.0, block_rows=64))
    assert max(v["repetition"] for v in found.values()) == pytest.approx(2.0, abs=1e-3) and min(v["repetition"] for v in found.values()) == pytest.approx(1.0, abs=1e-9)
    assert all(min(v["copies"]) >= 1 for v in found.values())
    both = by_source(mixing.mix(docs(spark), target_entropy=0.99, max_repetition=4.0, budget_tokens="corpus"))
    assert max(v["repetition"] for v in both.values()) == pytest.approx(4.0, abs=1e-2)


def test_plain_realisation(spark):
    """Blocks in permuted order, then documents in permuted order, as far as the budget goes."""
    from pyspark.sql import functions as F

    mixed = mixing.mix(docs(spark), target_entropy=0.9, budget_tokens="corpus", block_rows=64)
    rows = mixed.withColumns({"bk": F.xxhash64("block", F.lit(18)), "dk": F.xxhash64("doc_id", F.lit(19))}).collect()
    for source in SIZES:
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["bk"], r["block"], r["dk"], r["doc_id"]))
        whole = math.floor(own[0]["repetition"])
        left, used, stopped = (own[0]["repetition"] - whole) * totals()[source], 0, False
        for r in own:
            fits = used + r["n_tokens"] <= left + 1e-6
            block_over = stopped is not False and stopped != r["block"]
            assert r["copies"] == whole + (fits and not block_over)
            used += r["n_tokens"]
            if not fits and stopped is False:
                stopped = r["block"]


def test_exponent_against_plain(spark):
    """Weights and repetition by halving in plain Python, to a target entropy and to a repetition limit."""
    own = totals()
    share = {k: v / sum(own.values()) for k, v in own.items()}

    def weights(a):
        power = {k: p**a for k, p in share.items()}
        return {k: v / sum(power.values()) for k, v in power.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values()) / math.log(len(share))

    def repeated(a):
        return max(w / share[k] for k, w in weights(a).items())

    for goal, options in ((lambda a: entropy(a) <= 0.9, {"target_entropy": 0.9}), (lambda a: repeated(a) <= 1.7, {"max_repetition": 1.7, "target_entropy": 1.0})):
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if goal(middle) else (middle, high)
        found = mixing.mix(docs(spark), budget_tokens="corpus", **options).select("source", "weight", "repetition").distinct().collect()
        assert {r["source"]: r["weight"] for r in found} == pytest.approx(weights(high), abs=1e-6)
        assert {r["source"]: r["repetition"] for r in found} == pytest.approx({k: w / share[k] for k, w in weights(high).items()}, abs=1e-5)


def test_realise_repeats_rows_and_keeps_columns(spark):
    out = mixing.realise(docs(spark), max_repetition=2.0)
    assert out.columns == docs(spark).columns and out.select("doc_id").distinct().count() == sum(SIZES.values()) and out.count() > sum(SIZES.values())
    epochs = mixing.schedule(mixing.mix(docs(spark), max_repetition=2.0)).where("source = 'low'").select("epoch").distinct().count()
    assert epochs == 2


def test_realise_leaves_columns_with_names_of_its_own(spark):
    out = mixing.realise(frame(spark), max_repetition=3.0)
    assert out.columns == frame(spark).columns
    assert {(r["doc_id"], r["copies"], r["score"]) for r in out.collect()} == {(r[0], r[7], r[6]) for r in awkward()}


def test_awkward_rows(spark):
    rows = mixing.mix(frame(spark), max_repetition=3.0).collect()
    assert len(rows) == len(awkward()) and all(r["copies"] >= 1 for r in rows)
    words = {r[0]: len((r[1] or "").encode().split()) for r in awkward()}
    assert all(r["n_tokens"] == words[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert mixing.mix(frame(spark, []), max_repetition=3.0).count() == 0
    only_blank = [(1, None, None, "a", None, None, None, None), (2, " ", None, None, None, None, None, None)]
    assert [r["copies"] for r in mixing.mix(frame(spark, only_blank), target_entropy=0.5).collect()] == [1, 1]
