"""Provisions to chunks: folds over ordered paragraphs, all inside one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import uuid5

# Marker of a numbered paragraph, end of a sentence, formats.
MARKER = r"^(\d{1,3})\s?(?:\.\s?º|\.º|º|\.\s?ª|ª|\.)\s+\S"
SENTENCE_END = r"(?<=[.;:])\s+"
NOTE = "[Nota de la edición consolidada: {}]"
EMPTY = "(Sin contenido)"
URL = "https://www.boe.es/buscar/act.php?id="
MAX_CHARS = 3200

PARAGRAPH = "struct<kind:string,text:string,css_class:string>"


def size(paragraphs: Column) -> Column:
    """Characters, one more for each paragraph."""
    return F.aggregate(paragraphs, F.lit(0), lambda a, p: a + F.length(p["text"]) + 1)


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _pack(parts: Column, limit: int, glue: str, head: Column | None = None) -> Column:
    """Joins ``parts`` greedily with ``glue`` while the text (``head`` before it) keeps within ``limit``; a longer part stays whole."""
    room = F.lit(limit) if head is None else F.lit(limit) - F.length(head) - len(glue)
    start = F.struct(_none("string").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(a: Column, part: Column) -> Column:
        full = F.coalesce((a["held"] != "") & (F.length(a["held"]) + F.length(part) + len(glue) > room), F.lit(False))
        joined = F.when(F.coalesce(a["held"], F.lit("")) == "", part).otherwise(F.concat(a["held"], F.lit(glue), part))
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]).alias("done"), F.when(full, part).otherwise(joined).alias("held"))

    texts = F.aggregate(parts, start, step, lambda a: F.when(F.coalesce(a["held"], F.lit("")) == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["held"]))))
    return texts if head is None else F.transform(texts, lambda t: F.concat(head, F.lit(glue), t))


def sentences(text: Column, limit: int) -> Column:
    """Pieces of whole sentences within ``limit`` characters; a longer sentence is a piece of its own."""
    return _pack(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), limit, " ")


def table_rows(text: Column, limit: int) -> Column:
    """Pieces of a markdown table, each with the lines up to the separator."""
    lines = F.split(text, "\n")
    ruled = F.transform(lines, lambda x: x.startswith("|") & x.contains("---"))
    at = F.array_position(ruled, True).cast("int")
    head = F.array_join(F.slice(lines, 1, at), "\n")
    return _pack(F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))), limit, "\n", head)


def explode_long(paragraphs: Column, limit: int) -> Column:
    """Paragraphs over ``limit`` characters split: tables by rows, others by sentences."""

    def parts(p: Column) -> Column:
        texts = F.when(F.length(p["text"]) <= limit, F.array(p["text"])).when((p["kind"] == "table") & p["text"].contains("| --- |"), table_rows(p["text"], limit)).otherwise(sentences(p["text"], limit))
        return F.transform(texts, lambda t: F.struct(p["kind"].alias("kind"), t.alias("text"), p["css_class"].alias("css_class")))

    return F.flatten(F.transform(paragraphs, parts))


def windows(paragraphs: Column, limit: int) -> Column:
    """Greedy windows of whole paragraphs within ``limit``. A heading opens a window; a heading at a window's end moves on."""
    start = F.struct(_none(f"array<{PARAGRAPH}>").alias("done"), _none(PARAGRAPH).alias("held"))

    def step(a: Column, p: Column) -> Column:
        held = a["held"]
        closes = (F.size(held) > 0) & ((p["kind"] == "heading") | (size(held) + F.length(p["text"]) + 1 > limit))
        dangling = F.get(held, F.size(held) - 1)["kind"] == "heading"
        kept = F.when(dangling, F.slice(held, 1, F.size(held) - 1)).otherwise(held)
        carried = F.when(dangling, F.slice(held, F.size(held), F.lit(1))).otherwise(_none(PARAGRAPH))
        done = F.when(closes & (F.size(kept) > 0), F.concat(a["done"], F.array(kept))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.concat(F.when(closes, carried).otherwise(held), F.array(p)).alias("held"))

    last = lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"])
    return F.aggregate(explode_long(paragraphs, limit), start, step, last)


def apartado_starts(paragraphs: Column) -> Column:
    """Indexes of the paragraphs that open an apartado: a marker counts only if it is the next number."""
    marker = lambda p: F.when(p["kind"] == "text", F.nullif(F.regexp_extract(p["text"], MARKER, 1), F.lit("")).cast("int"))
    marked = F.filter(F.transform(paragraphs, lambda p, i: F.struct(i.alias("at"), marker(p).alias("n"))), lambda x: x["n"].isNotNull())
    # Of the paragraphs marked n, in order, the first after the place of n - 1 opens apartado n. Sorted by number, then place, they are
    # met in that order by one pass, which holds the last place and number and adds to a text, as an array would be copied each time.
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"), F.lit("").alias("found"))

    def step(a: Column, x: Column) -> Column:
        opens = (x["n"] == a["n"] + 1) & (x["at"] > a["at"])
        return F.struct(F.when(opens, x["n"]).otherwise(a["n"]).alias("n"), F.when(opens, x["at"]).otherwise(a["at"]).alias("at"), F.when(opens, F.concat(a["found"], F.lit(" "), x["at"].cast("string"))).otherwise(a["found"]).alias("found"))

    ordered = F.array_sort(F.transform(marked, lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"))))
    places = F.aggregate(ordered, start, step, lambda a: F.trim(a["found"]))
    return F.when(places == "", _none("int")).otherwise(F.transform(F.split(places, " "), lambda x: x.cast("int")))


def apartados(paragraphs: Column) -> Column:
    """array<struct<apartado,items>>: paragraphs by apartado; an introduction belongs to the first, without markers there is one group.

    Boundaries are found by one pass; each group is a slice between two of them."""

    def groups(bound: Column) -> Column:
        paragraphs, starts = bound["paragraphs"], bound["starts"]
        first = F.concat(F.array(F.lit(0)), F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))))
        stop = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(paragraphs)))
        bounds = F.arrays_zip(first.alias("a"), stop.alias("b"))
        number = lambda i: F.nullif(F.regexp_extract(F.get(paragraphs, F.get(starts, i))["text"], MARKER, 1), F.lit(""))
        return F.transform(bounds, lambda x, i: F.struct(number(i).alias("apartado"), F.slice(paragraphs, x["a"] + 1, x["b"] - x["a"]).alias("items")))

    # Paragraphs and starts are bound once, however many groups there are.
    return F.flatten(F.transform(F.array(F.struct(paragraphs.alias("paragraphs"), apartado_starts(paragraphs).alias("starts"))), groups))


def split(paragraphs: Column, limit: int = MAX_CHARS) -> Column:
    """array<struct<apartado,items>>: one piece if it fits, else apartados, else windows. No paragraphs make one empty piece."""
    piece = lambda apartado, items: F.struct(apartado.alias("apartado"), items.alias("items"))
    grouped = F.flatten(F.transform(apartados(paragraphs), lambda g: F.when(size(g["items"]) <= limit, F.array(piece(g["apartado"], g["items"]))).otherwise(F.transform(windows(g["items"], limit), lambda w: piece(g["apartado"], w)))))
    return F.when(size(paragraphs) <= limit, F.array(piece(F.lit(None).cast("string"), paragraphs))).otherwise(grouped)


def render(paragraphs: Column) -> Column:
    before, after = NOTE.split("{}")
    return F.array_join(F.transform(paragraphs, lambda p: F.when(p["kind"] == "note", F.concat(F.lit(before), p["text"], F.lit(after))).otherwise(p["text"])), "\n")


def embed_text(short_name: Column, title: Column, levels: Column, label: Column, heading: Column, apartado: Column, text: Column) -> Column:
    """The text under its context: norm, hierarchy, label with rubric and apartado."""
    name = F.concat(label, F.coalesce(F.concat(F.lit(". "), F.nullif(heading, F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit(" (apartado "), F.nullif(apartado, F.lit("")), F.lit(")")), F.lit("")))
    return F.concat_ws("\n", F.concat(short_name, F.lit(" — "), title), levels, name, text)


def chunk_id(norm_id: Column, block_id: Column, seq: Column) -> Column:
    return uuid5(F.concat(norm_id, F.lit("#"), block_id, F.lit("#"), seq.cast("string")))


def deep_link(norm_id: Column, block_id: Column) -> Column:
    return F.concat(F.lit(URL), norm_id, F.lit("#"), block_id)


def citation_label(short_name: Column, kind: Column, number: Column, label: Column, apartado: Column) -> Column:
    """"LCS, art. 18.1", "LCS, Disposición adicional primera, apartado 2"."""
    article = kind == "articulo"
    base = F.when(article, F.concat(F.lit("art. "), F.coalesce(F.nullif(number, F.lit("")), label))).otherwise(label)
    part = F.nullif(apartado, F.lit(""))
    return F.concat(short_name, F.lit(", "), base, F.coalesce(F.concat(F.when(article, ".").otherwise(", apartado "), part), F.lit("")))


def chunk_provisions(provisions: DataFrame, norms: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """One row per chunk, with the norm's attributes. ``consolidated_as_of`` is the norm's latest block date."""
    dated = provisions.groupBy("norm_id").agg(F.max("block_updated_at").alias("consolidated_as_of"))
    attributes = norms.select("norm_id", F.col("short_name").alias("norm_short_name"), F.col("title").alias("norm_title"), "jurisdiction", "legal_effect", "rank", "topics", "application_date")
    pieces = provisions.withColumn("pieces", split(F.col("paragraphs"), limit)).select("*", F.posexplode("pieces").alias("seq", "piece")).drop("pieces", "paragraphs")
    rows = pieces.join(attributes.join(dated, "norm_id"), "norm_id").withColumn("apartado", F.col("piece.apartado"))
    fallback = F.when(F.col("repealed"), F.lit(EMPTY)).otherwise(F.col("label"))
    rows = rows.withColumn("text", F.coalesce(F.nullif(render(F.col("piece.items")), F.lit("")), fallback))
    embedded = embed_text(F.col("norm_short_name"), F.col("norm_title"), F.col("hierarchy"), F.col("label"), F.col("heading"), F.col("apartado"), F.col("text"))
    return rows.select(
        chunk_id(F.col("norm_id"), F.col("block_id"), F.col("seq")).alias("chunk_id"), "norm_id", "norm_short_name", "block_id", "seq", "kind", "label", "number", "heading",
        "apartado", "hierarchy", "text", embedded.alias("embed_text"), deep_link(F.col("norm_id"), F.col("block_id")).alias("url"), "version_in_force_since", "block_updated_at",
        "consolidated_as_of", "repealed", "jurisdiction", "legal_effect", "rank", "topics", "application_date", F.array().cast("array<string>").alias("refs_out"),
    )
