"""Snowball stemming of Spanish terms, after the published algorithm, on Arrow batches of distinct terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOWELS = frozenset("aeiouáéíóúü")
_UNACCENT = str.maketrans("áéíóú", "aeiou")

# Suffixes of the published algorithm, by the region they must lie in and what becomes of them.
_PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
_BEFORE_PRONOUN = "iéndo ándo ár ér ír iendo ando ar er ir".split()
_DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_DELETE_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_VERBS_GU = "en es éis emos".split()
_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían "
    "aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _region(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _verb_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in _VOWELS), len(word))
    if word[0] in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in _VOWELS), len(word))
    return 3


def _longest(word: str, suffixes, start: int = 0) -> str:
    """The longest of ``suffixes`` that ends ``word`` and begins at or after ``start``."""
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= start), key=len, default="")


def _drop(word: str, suffixes, start: int) -> str:
    found = _longest(word, suffixes, start)
    return word[: len(word) - len(found)]


def _pronoun(word: str, rv: int) -> str:
    found = _longest(word, _PRONOUNS, rv)
    if not found:
        return word
    rest = word[: -len(found)]
    before = _longest(rest, _BEFORE_PRONOUN, rv)
    if before:
        return rest[: -len(before)] + before.translate(_UNACCENT)
    return rest if rest.endswith("uyendo") and len(rest) - 5 >= rv else word


def _standard(word: str, r1: int, r2: int) -> str:
    endings = [*_DELETE, *_DELETE_IC, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
    found = _longest(word, endings)
    stem = word[: len(word) - len(found)]
    if not found or len(stem) < (r1 if found == "amente" else r2):
        return word
    if found in _DELETE:
        return stem
    if found in _DELETE_IC:
        return _drop(stem, ["ic"], r2)
    if found.startswith("log"):
        return stem + "log"
    if found.startswith("uc"):
        return stem + "u"
    if found.startswith("enc"):
        return stem + "ente"
    if found == "amente":
        shorter = _drop(stem, ["iv", "os", "ic", "ad"], r2)
        return _drop(shorter, ["at"], r2) if stem.endswith("iv") and shorter != stem else shorter
    if found == "mente":
        return _drop(stem, ["ante", "able", "ible"], r2)
    if found.startswith("idad"):
        return _drop(stem, ["abil", "ic", "iv"], r2)
    return _drop(stem, ["at"], r2)


def _verb(word: str, rv: int) -> str:
    found = _longest(word, _Y_VERBS, rv)
    if found and word[: -len(found)].endswith("u"):
        return word[: -len(found)]
    found = _longest(word, [*_VERBS, *_VERBS_GU], rv)
    if not found:
        return word
    stem = word[: -len(found)]
    return stem[:-1] if found in _VERBS_GU and stem.endswith("gu") else stem


def _residual(word: str, rv: int) -> str:
    found = _longest(word, ["os", "a", "o", "á", "í", "ó"], rv)
    if found:
        return word[: -len(found)]
    if _longest(word, ["e", "é"], rv):
        stem = word[:-1]
        return stem[:-1] if stem.endswith("gu") and len(stem) - 1 >= rv else stem
    return word


def stem_word(word: str) -> str:
    """Stem of a lower-case word."""
    r1 = _region(word, 0)
    r2, rv = _region(word, r1), _verb_region(word)
    word = _pronoun(word, rv)
    shorter = _standard(word, r1, r2)
    if shorter == word:
        shorter = _verb(word, rv)
    return _residual(shorter, rv).translate(_UNACCENT)


@F.pandas_udf(StringType())
def _stem(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: t if t is None or t[:1].isdigit() else stem_word(t))


def stem(term: Column) -> Column:
    return _stem(term)


def with_stems(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """``terms`` with its column replaced by stems. Distinct terms only go through Python."""
    stems = terms.select(term_col).distinct().withColumn("__stem", stem(F.col(term_col)))
    return terms.join(stems, term_col).withColumn(term_col, F.col("__stem")).drop("__stem")
