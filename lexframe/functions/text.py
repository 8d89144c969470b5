"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what is left of them without.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçªº\u00a0"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncao "

# Function words that carry no signal in Spanish legal text.
STOPWORDS = (
    "a al algo algun alguna algunas alguno algunos ante antes aquel aquella aquellas aquello "
    "aquellos asi aun aunque cada como con contra cual cuales cualquier cuando de del desde donde "
    "dos el ella ellas ello ellos en entre era eran es esa esas ese eso esos esta estas este esto "
    "estos fue fueron ha han hasta hay la las le les lo los mas me mi mientras muy ni no nos o os "
    "otra otras otro otros para pero por porque que quien quienes se sea sean segun ser si sin "
    "sino sobre su sus tal tambien tan tanto te tiene tienen todo todos tu un una unas uno unos y "
    "ya"
).split()

TOKEN = r"\d+(?:[./]\d+)*|[a-z]+"


@lru_cache(maxsize=1)
def decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Code points whose compatibility decomposition without combining marks is another text: those with one character left or none, and
    those with several. Hangul syllables, which decompose by arithmetic, are left to ``_jamo``."""
    one, several = {"\u00a0": " "}, {}
    for point in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)):
        char = chr(point)
        if unicodedata.combining(char) or unicodedata.decomposition(char):
            left = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if left != char:
                (one if len(left) < 2 else several)[char] = left
    return one, several


_FOREIGN = "[^\\x00-\\x7f]"


def _jamo(syllable: Column) -> Column:
    """The two or three letters of a Hangul syllable."""
    n = F.ascii(syllable) - 0xAC00
    char = lambda point: F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")
    last = F.when(n % 28 == 0, F.lit("")).otherwise(char(0x11A7 + n % 28))
    return F.concat(char(0x1100 + F.floor(n / 588)), char(0x1161 + F.floor(n % 588 / 28)), last)


def normalize(text: Column) -> Column:
    """Lower case, compatibility characters decomposed ("m²" is "m2", "ﬁ" is "fi"), combining marks dropped; punctuation stays."""
    one, several = decompositions()
    kept, dropped = [c for c in one if one[c]], [c for c in one if not one[c]]
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{to}" for c, to in several.items())), F.lit("\x01"), F.lit("\x02"))
    syllable = lambda c: F.ascii(c).between(0xAC00, 0xD7A3)
    spread = lambda c: F.coalesce(F.try_element_at(table, c), F.when(syllable(c), _jamo(c)), c)
    foreign = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(_FOREIGN), F.lit(0)))

    # Text and table are bound once each, as expressions that repeat them would grow with every use of the result. Most texts are
    # ASCII after the first step; of the others each different character is looked up once.
    plain = F.transform(F.array(text), lambda t: F.when(t.rlike(_FOREIGN), F.translate(t, "".join([*kept, *dropped]), "".join(one[c] for c in kept))).otherwise(t))
    whole = F.transform(plain, lambda t: F.when(t.rlike(_FOREIGN), F.aggregate(foreign(t), t, lambda a, c: F.replace(a, c, spread(c)))).otherwise(t))
    return F.lower(whole[0])


def normalize_latin(text: Column) -> Column:
    """``normalize`` for titles, labels and numerals: the letters of western European languages only, in a far smaller expression."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}", ""), ACCENTED, PLAIN)


def clean(text: Column) -> Column:
    """White space, no-break spaces included, collapsed to one space and trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "\u00a0", " "), r"(?U)\s+", " "))


def tokenize(text: Column) -> Column:
    """Array of terms: numbers (with inner . or /) and letter runs, function words dropped, unstemmed."""
    return F.filter(F.regexp_extract_all(normalize(text), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOPWORDS))


def term_id(term: Column) -> Column:
    """31-bit id of a term."""
    return F.crc32(term.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def parse_date(text: Column) -> Column:
    """Date in the first eight digits; anything else is an error in ANSI mode."""
    return F.to_date(F.substring(text, 1, 8), "yyyyMMdd")


# Fixed value: the name space of chunk ids.
CHUNK_NAMESPACE = "5b0e1f0c5a8e4c389a532a1f5c3e7d10"


def uuid5(name: Column, namespace: str = CHUNK_NAMESPACE) -> Column:
    """Version 5 UUID of ``name``: SHA-1 with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, 1)
    part = lambda start, n: F.substring(digest, start, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
