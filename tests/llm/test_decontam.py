import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexframe.llm import decontam

from .inputs import awkward, frame, words


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items):
    ws, hit, found = tokens(text), set(), set()
    for item, it in items:
        iw = tokens(it)
        n = min(10, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1):
            if n and tuple(ws[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def items_of():
    rng = random.Random(9)
    docs = awkward()
    return [
        (1, " ".join((docs[8][1] or "").split()[5:22]).upper()), (2, " ".join(words(rng, 30))), (3, "uno"), (4, None), (5, "- , ."), (10, "dos, tres"),
        (None, " ".join(docs[9][1].split()[:12])), (1, " ".join(docs[6][1].split()[700:715])), (12, "w1 w2 w1"), (13, "É"),
    ]


@pytest.mark.parametrize("block", [decontam.MAX_BLOCK_BYTES, 120])
def test_against_plain(spark, block):
    items = items_of()
    rows = decontam.contamination(frame(spark), table(spark, items), max_block_bytes=block).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows), key=repr)
    assert got == sorted(((d[0], *plain(d[1], items)) for d in awkward()), key=repr)
    assert all(r["n_hit"] == sum(s["stop"] - s["start"] for s in r["spans"]) for r in rows)


@pytest.mark.parametrize("block", [decontam.MAX_BLOCK_BYTES, 120])
def test_drop(spark, block):
    docs = frame(spark)
    kept = decontam.drop_contaminated(docs, table(spark, items_of()), max_block_bytes=block)
    assert kept.columns == docs.columns
    assert sorted((r["text"] or "" for r in kept.collect())) == sorted(d[1] or "" for d in awkward() if not plain(d[1], items_of())[4])


def test_random_texts_with_few_words(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))) for i in range(25)]
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60))), None, None, None, None, None, None) for i in range(80)]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(frame(spark, docs), table(spark, items)).collect()}
    assert got == {d[0]: plain(d[1], items) for d in docs}


def test_empty_tables(spark):
    assert decontam.contamination(frame(spark, []), table(spark, items_of())).count() == 0
    rows = decontam.contamination(frame(spark), table(spark, [])).collect()
    assert len(rows) == len(awkward()) and not any(r["contaminated"] for r in rows)
    assert decontam.drop_contaminated(frame(spark), table(spark, [])).count() == len(awkward())


def test_invalid_bytes_are_word_characters(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61ff20622063') AS STRING) AS text")
    items = spark.sql("SELECT 1L AS item_id, CAST(unhex('61ff2062') AS STRING) AS text")
    row = decontam.contamination(df, items).first()
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (3, 2, 1)


def test_blocks_stay_under_their_bound(spark):
    """Repeated rows count once, and no block of different ones exceeds the bound by more than a cell."""
    same = spark.range(20_000).select(F.lit(1).cast("long").alias("item_id"), F.lit("one and the same text of an item").alias("text"))
    blocks, n = decontam._blocks(same, "item_id", "text", 100_000)
    assert n == 1 and blocks.count() == 1
    rows = same.unionByName(spark.range(5000).select(F.col("id").alias("item_id"), F.concat(F.lit("a text of its own "), F.col("id")).alias("text")))
    blocks, n = decontam._blocks(rows, "item_id", "text", 30_000)
    sizes = [r[1] for r in blocks.groupBy("block").agg(F.sum(F.octet_length("text") + 32)).collect()]
    assert blocks.count() == 5001 and len(sizes) == n and max(sizes) <= 30_000
