"""Spanish numerals in words as column expressions over closed vocabularies, precomputed by rule."""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_latin

# Cardinal and ordinal words without accents.
CARDINALS = {
    "cero": 0, "un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10,
    "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19, "veinte": 20,
    "veintiun": 21, "veintiuno": 21, "veintiuna": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24, "veinticinco": 25, "veintiseis": 26,
    "veintisiete": 27, "veintiocho": 28, "veintinueve": 29, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80,
    "noventa": 90, "cien": 100, "ciento": 100, "doscientos": 200, "trescientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600,
    "setecientos": 700, "ochocientos": 800, "novecientos": 900,
}
ORDINAL_UNITS = {"primer": 1, "segund": 2, "tercer": 3, "cuart": 4, "quint": 5, "sext": 6, "septim": 7, "setim": 7, "octav": 8, "noven": 9}
ORDINAL_TENS = {"decim": 10, "vigesim": 20, "trigesim": 30, "cuadragesim": 40, "quincuagesim": 50, "sexagesim": 60, "septuagesim": 70, "octogesim": 80, "nonagesim": 90}
ORDINAL_OTHERS = {"undecim": 11, "duodecim": 12, "centesim": 100}
LATIN_SUFFIXES = ("bis", "ter", "quater", "quinquies", "sexies", "septies", "octies", "nonies", "decies")
KIND_PREFIX = r"^(articulo|disposicion (adicional|transitoria|derogatoria|final))\s*"


@cache
def ordinals() -> dict[str, int]:
    """Every single ordinal word: simple ones, and tens fused with units by a linking vowel that may be elided."""
    endings = ("", "o", "a")
    words = {stem + e: n for table in (ORDINAL_UNITS, ORDINAL_TENS, ORDINAL_OTHERS) for stem, n in table.items() for e in endings}
    for tens, n in ORDINAL_TENS.items():
        for unit, k in ORDINAL_UNITS.items():
            for e in endings:
                for link in ("o", "a", ""):
                    words.setdefault(tens + link + unit + e, n + k)
    return words


def _lookup(words: dict[str, int]) -> Column:
    return F.from_json(F.lit(json.dumps(words)), "map<string,int>")


def _total(words: Column, table: Column) -> Column:
    """Sum of the words' values; null if there is none or one is unknown."""
    values = F.transform(words, lambda w: F.try_element_at(table, w))
    total = F.aggregate(values, F.lit(0), lambda a, v: a + v)
    return F.when(F.size(words) > 0, total)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def cardinal(text: Column) -> Column:
    """"trescientos siete" -> 307; null unless every word is a cardinal (or "y")."""
    return _total(F.filter(_words(normalize_latin(text)), lambda w: w != "y"), _lookup(CARDINALS))


def ordinal(text: Column) -> Column:
    """"trigésimo segunda", "decimosexta" -> 32, 16; null if a word is unknown."""
    return _total(_words(normalize_latin(text)), _lookup(ordinals()))


def number(text: Column) -> Column:
    """Digits, cardinal words or ordinal words as an int."""
    plain = F.rtrim(F.regexp_replace(F.trim(normalize_latin(text)), r"\.+$", ""))
    digits = F.regexp_extract(plain, r"^(\d+)[.ao°]*$", 1)
    return F.coalesce(F.when(digits != "", digits.cast("int")), cardinal(plain), ordinal(plain))


def provision_number(title: Column) -> Column:
    """Canonical number of a provision's title: "41", "7 quater", "16", "única", "5 c"; null if it has none."""
    text = F.regexp_replace(F.trim(F.regexp_replace(normalize_latin(title), KIND_PREFIX, "")), r"\.+$", "")
    tokens = F.regexp_extract_all(text, F.lit(r"([a-z]+|\d+)"), F.lit(1))
    last = F.try_element_at(tokens, F.lit(-1))
    latin = last.isin(*LATIN_SUFFIXES)
    lettered = (F.size(tokens) > 1) & text.rlike(r"\b[a-z]\)$")
    has_suffix = F.coalesce(latin | lettered, F.lit(False))
    rest = F.when(has_suffix, F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    head = F.try_element_at(rest, F.lit(1))
    value = F.when(head.rlike(r"^\d+$"), head).otherwise(number(F.array_join(rest, " ")).cast("string"))
    suffix = F.when(has_suffix, F.concat(F.lit(" "), last)).otherwise(F.lit(""))
    return F.when(text == "unica", "única").when(text == "unico", "único").when(F.size(rest) > 0, F.concat(value, suffix))

