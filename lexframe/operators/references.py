"""Citations in text: norms mentioned, provisions referred to, and their lookup."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerals import ordinal
from ..functions.text import normalize
from . import aliases

# Patterns over normalised text.
ARTICLE = r"\b(?:articulos?|arts?\.?)\s*(\d+)(?:\s*(bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies)\b)?((?:\s*\.\s*\d+)?)"
DISPOSITIONS = {
    "disposicion_adicional": r"\b(?:disposicion(?:es)?\s+adicional(?:es)?|d\.?\s?a\.?)\s+",
    "disposicion_transitoria": r"\b(?:disposicion(?:es)?\s+transitoria(?:s)?|d\.?\s?t\.?)\s+",
    "disposicion_final": r"\b(?:disposicion(?:es)?\s+final(?:es)?|d\.?\s?f\.?)\s+",
}
ORDINAL = r"(\d+|[a-z]+(?:simo|sima) [a-z]+|[a-z]+)(?:\s*[.°])?(?!\w)"
OF_NORM = r"^[\s,.]*(de|del)\b"
NEXT_MENTION = r"\b(articulo|art\.|disposicion)\b"
WINDOW = 90
LOOKUP_CAP, HITS_PER_REFERENCE, REFERENCE_SCORE = 200, 3, 1.0
GOLD = r"^(.+?) (art\.|DA|DT|DD|DF|anexo) (.+)$"
GOLD_KINDS = {"art.": "articulo", "DA": "disposicion_adicional", "DT": "disposicion_transitoria", "DD": "disposicion_derogatoria", "DF": "disposicion_final", "anexo": "anexo"}


_PLACES = pa.list_(pa.struct([("at", pa.int32()), ("rank", pa.int32()), ("norm_id", pa.string())]))


def _plain(text: Column) -> Column:
    """Normalised, ordinal marks removed first so that "4.ª del" keeps its "del"."""
    return normalize(F.regexp_replace(text, r"(?<=\d)\s*\.?\s*[ºª°]", ""))


def _mentions(text: Column, pattern: str) -> Column:
    """array<struct<hit,tail>>: every match and the text from it to the next match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tails = F.split(text, pattern)
    return F.transform(hits, lambda h, i: F.struct(h.alias("hit"), F.get(tails, i + 1).alias("tail")))


def _near(tail: Column) -> Column:
    """The text in which a reference's norm would stand, or null."""
    near = F.split(F.substring(tail, 1, WINDOW), NEXT_MENTION, 2)[0]
    return F.when(near.rlike(OF_NORM), near)


def _dispositions(plain: Column, kind: str, pattern: str) -> Column:
    """References to dispositions of one kind; a second word that is no ordinal is left to the text."""

    def one(m: Column) -> Column:
        words = F.regexp_extract(m["hit"], pattern, 1)
        digits = F.when(words.rlike(r"^\d+$"), words.cast("int"))
        value = F.coalesce(digits, ordinal(words), ordinal(F.split(words, " ")[0]))
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("number"), F.lit(None).cast("string").alias("apartado"), _near(m["tail"]).alias("near"))

    return F.filter(F.transform(_mentions(plain, pattern), one), lambda r: r["number"].isNotNull())


def parse_references(text: Column) -> Column:
    """array<struct<kind,number,apartado,near>> of the provisions referred to: articles, then dispositions; ``near`` may name their norm."""
    plain = _plain(text)

    def article(m: Column) -> Column:
        part = lambda i: F.regexp_extract(m["hit"], ARTICLE, i)
        name = F.concat(part(1), F.when(part(2) != "", F.concat(F.lit(" "), part(2))).otherwise(F.lit("")))
        return F.struct(F.lit("articulo").alias("kind"), name.alias("number"), F.nullif(F.regexp_replace(part(3), r"\D", ""), F.lit("")).alias("apartado"), _near(m["tail"]).alias("near"))

    found = [F.transform(_mentions(plain, ARTICLE), article)]
    for kind, opening in DISPOSITIONS.items():
        found.append(_dispositions(plain, kind, opening + ORDINAL))
    return F.concat(*found)


def _first_norms(batch: pa.RecordBatch, automaton: aliases.Automaton) -> pa.Array:
    """For each reference the norm that ``near`` names first, with its place; of aliases at one place the longest."""
    best = [[min(automaton.places(r["near"]), default=None) for r in refs] for refs in batch.column("refs").to_pylist()]
    return pa.array([[b and dict(zip(("at", "rank", "norm_id"), b, strict=True)) for b in row] for row in best], _PLACES)


def references(texts: DataFrame, catalog: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ref, kind, number, apartado, norm_id) without repeats, ``ref`` the order in the text's list."""
    known = aliases.automata(catalog)
    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(parse_references(F.col(text_col)), F.array().cast("array<struct<kind:string,number:string,apartado:string,near:string>>")).alias("refs"))
    found = aliases.mapped(rows, known, _first_norms, "array<struct<at:int,rank:int,norm_id:string>>", "norms")
    # Blocks of aliases are compared by place, then rank, as the aliases of one block are.
    best = lambda i: F.array_min(F.array_compact(F.array(*[F.get(f"norms_{k}", i) for k in range(len(known))])))["norm_id"]
    named = F.transform("refs", lambda r, i: F.struct(r["kind"].alias("kind"), r["number"].alias("number"), r["apartado"].alias("apartado"), best(i).alias("norm_id")))
    return found.select(F.col("id").alias(id_col), F.posexplode(F.array_distinct(named)).alias("ref", "r")).select(id_col, "ref", "r.*")


def find_provisions(refs: DataFrame, chunks: DataFrame, keys: list[str], limit: int = HITS_PER_REFERENCE) -> DataFrame:
    """Chunks of the provisions that ``refs`` (keys, kind, number, apartado, norm_id) name, with their ``place``.

    At most LOOKUP_CAP chunks in the order of (norm_id, seq) are considered; of these the named apartado, else undivided
    chunks, else all are taken.
    """
    wanted = refs.select(*keys, "kind", "number", F.col("apartado").alias("__apartado"), "norm_id")
    joined = wanted.join(chunks, ["kind", "number", "norm_id"])
    order = Window.partitionBy(*keys).orderBy("norm_id", "seq", "chunk_id")
    capped = joined.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= LOOKUP_CAP)
    choice = F.when(F.col("__apartado").isNull(), 0).when(F.col("apartado") == F.col("__apartado"), 0).when(F.col("apartado").isNull(), 1).otherwise(2)
    best = capped.withColumn("__choice", choice).withColumn("__best", F.min("__choice").over(Window.partitionBy(*keys)))
    chosen = best.where("__choice = __best").withColumn("place", F.row_number().over(order))
    return chosen.where(F.col("place") <= limit).drop("__n", "__choice", "__best", "__apartado")


def find_by_block(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the blocks that ``wanted`` (norm_id, block_id) names, with their ``place`` in the block."""
    found = chunks.join(wanted.select("norm_id", "block_id").distinct(), ["norm_id", "block_id"], "left_semi")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("norm_id", "block_id").orderBy("seq", "chunk_id")))


def reference_hits(refs: DataFrame, chunks: DataFrame, query_col: str, norms_of_filter: list[str] | None = None, limit: int = HITS_PER_REFERENCE) -> DataFrame:
    """(query, place, chunk_id, score, sources): references without a norm take those of the filter, else they are skipped."""
    own = F.when(F.col("norm_id").isNotNull(), F.array("norm_id")).otherwise(F.array(*map(F.lit, norms_of_filter or [])).cast("array<string>"))
    spread = refs.withColumn("norm_id", F.explode(own))
    hits = find_provisions(spread, chunks, [query_col, "ref"], limit)
    place = F.row_number().over(Window.partitionBy(query_col).orderBy("ref", "place"))
    return hits.select(query_col, place.alias("place"), "chunk_id", F.lit(REFERENCE_SCORE).alias("score"), F.array(F.lit("reference")).alias("sources"))


def parse_gold(refs: DataFrame, norms: DataFrame, ref_col: str = "ref") -> DataFrame:
    """``refs`` with (norm_id, kind, number, block_id) of "SHORT kind NUMBER"; a malformed reference or unknown norm is an error."""
    part = lambda i: F.regexp_extract(F.trim(F.col(ref_col)), GOLD, i)
    kinds = F.create_map(*[F.lit(x) for pair in GOLD_KINDS.items() for x in pair])
    split = refs.withColumns({"__short": part(1), "__kind": part(2), "__number": part(3)})
    joined = split.join(norms.select(F.col("short_name").alias("__short"), "norm_id"), "__short", "left")
    wrong = F.raise_error(F.concat(F.lit("gold reference: "), F.col(ref_col)))
    kind = F.try_element_at(kinds, F.col("__kind"))
    return joined.select(
        *refs.columns, F.coalesce("norm_id", wrong).alias("norm_id"), kind.alias("kind"),
        F.when(kind != "anexo", F.col("__number")).alias("number"), F.when(kind == "anexo", F.col("__number")).alias("block_id"),
    )


def gold_label(short_name: Column, kind: Column, number_col: Column, block_id: Column) -> Column:
    names = F.create_map(*[F.lit(x) for alias, kind_name in GOLD_KINDS.items() for x in (kind_name, alias)])
    return F.concat_ws(" ", short_name, F.try_element_at(names, kind), F.coalesce(block_id, number_col))
