import functools
from pathlib import Path

import pytest

from lexframe.llm import tokens

from .inputs import awkward, frame

SMALL = tokens.Unigram({"▁": -1.0, "▁un": -2.0, "o": -2.5, "▁uno": -4.0, "d": -3.0, "os": -2.0, "w1": -2.0, "w": -3.0, "1": -3.0, "2": -3.0}, 4, -5.0)


def plain(model, token):
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        width = len(token[end - 1].encode())
        options = [(best[end - 1][0] + width * model.byte_score, -(best[end - 1][1] + width))]
        options += [(best[s][0] + model.scores[token[s:end]], -(best[s][1] + 1)) for s in range(max(0, end - model.longest), end) if token[s:end] in model.scores]
        score, count = max(options)
        best.append((score, -count))
    return best[-1][1]


def models():
    yield SMALL
    if Path(tokens.VOCABULARY).exists():
        yield tokens.load()


@pytest.mark.parametrize("nodes", [tokens.NODES, 50])
def test_against_plain(spark, monkeypatch, nodes):
    monkeypatch.setattr(tokens, "NODES", nodes)
    for model in models():
        count = functools.cache(lambda w, model=model: plain(model, tokens.MARK + w))
        rows = sorted(map(tuple, tokens.token_counts(frame(spark), model).collect()), key=repr)
        split = lambda t: [w.decode() for w in (t or "").encode().split()]
        assert rows == sorted(((d[0], len(split(d[1])), sum(map(count, split(d[1])))) for d in awkward()), key=repr)


def test_long_word_and_empty_table(spark):
    word = "abcuno" * 3000
    row = tokens.token_counts(frame(spark, [(1, word, None, None, None, None, None, None)]), SMALL).first()
    assert row["n_tokens"] == plain(SMALL, tokens.MARK + word)
    assert tokens.token_counts(frame(spark, []), SMALL).count() == 0


def test_invalid_bytes_are_single_characters(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(unhex('756eff6f20c3') AS STRING) AS text")
    row = tokens.token_counts(df, SMALL).first()
    assert (row["n_words"], row["n_tokens"]) == (2, 5)
