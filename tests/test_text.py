import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from lexframe.functions import numerals, stem, text


def one(spark, column, *values, names="a"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"{names} string").select(column).collect()]


def test_normalize_keeps_punctuation(spark):
    assert one(spark, text.normalize(F.col("a")), "ARTÍCULO 20/2015, Ñandú 1.ª x", None) == ["articulo 20/2015, nandu 1.a x", None]


def test_clean_collapses_all_space(spark):
    assert one(spark, text.clean(F.col("a")), "  a   b\n") == ["a b"]


def test_tokens(spark):
    assert one(spark, text.tokenize(F.col("a")), "El artículo 10 de la Ley 20/2015 y el 3.5 bis") == [["articulo", "10", "ley", "20/2015", "3.5", "bis"]]


def test_term_ids_and_uuid5(spark):
    words = ["ley", "20/2015", "ñ"]
    assert one(spark, text.term_id(F.col("a")), *words) == [zlib.crc32(w.encode()) & 0x7FFFFFFF for w in words]
    names = ["N#a1#0", "N#a1#1", "ñ#x#12", ""]
    assert one(spark, text.uuid5(F.col("a")), *names) == [str(uuid.uuid5(uuid.UUID(text.CHUNK_NAMESPACE), n)) for n in names]


@pytest.mark.parametrize("words, n", [("diecisiete", 17), ("ciento tres", 103), ("cuarenta y ocho", 48), ("trigésimo segunda", 32), ("vigesimoprimera", 21), ("decimoctava", 18), ("undécima", 11), ("centésimo", 100), ("primer", 1), ("12", 12), ("5.º", 5), ("hola", None), ("", None)])
def test_numbers(spark, words, n):
    assert one(spark, numerals.number(F.col("a")), words) == [n]


@pytest.mark.parametrize("title, number", [("Artículo ciento veinte", "120"), ("Artículo 9 quater", "9 quater"), ("Artículo tercero ter", "3 ter"), ("Disposición transitoria única.", "única"), ("Artículo treinta. b)", "30 b"), ("ANEXO", None), ("", None)])
def test_provision_numbers(spark, title, number):
    assert one(spark, numerals.provision_number(F.col("a")), title) == [number]


def test_stems_of_hand_checked_words():
    pairs = {"contratos": "contrat", "contrato": "contrat", "aseguradora": "asegur", "aseguradoras": "asegur", "obligaciones": "oblig", "rápidamente": "rapid", "leyes": "ley", "comprándonos": "compr", "seguros": "segur", "riesgo": "riesg"}
    assert {w: stem.stem_word(w) for w in pairs} == pairs


def test_stems_of_terms(spark):
    terms = spark.createDataFrame([(1, "contratos"), (2, "20/2015"), (3, "contrato")], "id int, term string")
    assert sorted(map(tuple, stem.with_stems(terms).select("id", "term").collect())) == [(1, "contrat"), (2, "20/2015"), (3, "contrat")]


def test_normalize_is_the_compatibility_decomposition(spark):
    """Every code point that decomposes, and random texts, against the Unicode tables."""
    import random
    import unicodedata

    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.replace("\u00a0", " ")) if not unicodedata.combining(c)).lower()
    points = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x30000)]) if unicodedata.decomposition(c) or unicodedata.combining(c) or 0xAC00 <= ord(c) < 0xAC00 + 900]
    rng = random.Random(1)
    texts = ["".join(points[i : i + 40]) for i in range(0, len(points), 40)] + ["".join(rng.choice(points + list("aZ 1.ñ")) for _ in range(30)) for _ in range(200)]
    texts = [t for t in texts if all(plain(c.upper()) != "σ" for c in t)]  # the last sigma of a word is another letter
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize(F.col("t")).alias("n")).collect()
    wrong = [(r["t"], r["n"], plain(r["t"])) for r in rows if r["n"] != plain(r["t"])]
    assert len(rows) > 300 and not wrong, wrong[:3]
