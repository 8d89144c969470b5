"""Small awkward tables and plain versions of what the operators compute."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score double, copies int"


def words(rng, n, pool=300):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def awkward():
    """Null ids and texts, empty, blank and long texts, repeated rows, ties, and columns named like results."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000))
    base = [" ".join(words(rng, 60)) for _ in range(12)]
    texts = [None, "", " \t\n ", "uno", "Uno  dos", "uno dos tres", long, long + " fin", *base, *base[:5], base[0] + " x", "  " + base[1], base[2].replace(" ", "\n", 3), "É é ß z", "\x00 \x1f a"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x", 0.5, 9) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[8], (None, base[3], None, "s1", None, None, None, None), (None, "nadie", None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
