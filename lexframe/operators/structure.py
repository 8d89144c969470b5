"""Blocks to provisions: wording in force, scope, hierarchy, labels. One lazy plan for all norms."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerals import provision_number
from ..functions.text import normalize_latin

# Beginnings of normalised titles and what they mean.
HEADING_LEVELS = {"libro": 0, "titulo": 1, "capitulo": 2, "subseccion": 4, "seccion": 3}
KINDS = {
    "articulo": "articulo", "disposicion adicional": "disposicion_adicional", "disposicion transitoria": "disposicion_transitoria",
    "disposicion derogatoria": "disposicion_derogatoria", "disposicion final": "disposicion_final", "anexo": "anexo", "anejo": "anexo",
}
APPROVED_TEXT = ("texto", "reglamento")
SKIPPED_TYPES = ("preambulo", "firma", "nota_inicial")
HEADING_TYPES = ("encabezado", "cabecera")
AMENDING = r"^modificacion(es)? (de|del)\b"
REPEALED = r"(?i)^\(?\s*(derogad[oa]s?|sin contenido|suprimid[oa]s?|anulad[oa]s?|queda(n)? derogad[oa]s?)\b"
REPEALED_LABEL = r"(?i)\(\s*(derogad|sin contenido|suprimid|anulad)"
REPEALED_MAX = 200
LEVELS = range(5)


def _by_prefix(title: Column, table: dict) -> Column:
    norm, out = normalize_latin(title), F.lit(None)
    for prefix, value in reversed(table.items()):
        out = F.when(norm.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def heading_level(title: Column) -> Column:
    return _by_prefix(title, HEADING_LEVELS).cast("int")


def provision_kind(title: Column) -> Column:
    return _by_prefix(title, KINDS).cast("string")


def as_of(rows: DataFrame, keys: list[str], since: str, tie: str, day, expired: str | None = None) -> DataFrame:
    """Of each key the row with the latest ``since`` not after ``day``; of equal dates the least ``tie``. Keys whose ``expired`` day has come have none."""
    day = F.lit(day)
    current = rows.where(F.col(since) <= day)
    if expired:
        current = current.where(F.col(expired).isNull() | (F.col(expired) > day))
    order = Window.partitionBy(*keys).orderBy(F.desc(since), F.asc(tie))
    return current.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def as_of_join(rows: DataFrame, days: DataFrame, keys: list[str], since: str, day: str, value: str) -> DataFrame:
    """For every (keys, day) of ``days`` the ``value`` last set at or before it. One sort by key and time, no range join."""
    left = days.select(*keys, F.col(day).alias("__t"), F.lit(1).alias("__ask"), F.lit(None).cast(rows.schema[value].dataType).alias("__v"))
    right = rows.select(*keys, F.col(since).alias("__t"), F.lit(0).alias("__ask"), F.col(value).alias("__v"))
    order = Window.partitionBy(*keys).orderBy("__t", "__ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("__v", F.last("__v", ignorenulls=True).over(order))
    return both.where("__ask = 1").select(*keys, F.col("__t").alias(day), F.col("__v").alias(value))


def version_in_force(versions: Column, expired_on: Column, day: Column) -> Column:
    """The version struct in force on ``day``: latest date, first of equal dates; null if none or expired."""
    current = F.filter(versions, lambda v: v["in_force_since"] <= day)
    latest = F.array_max(F.transform(current, lambda v: F.struct(v["in_force_since"], -v["vord"])))
    chosen = F.get(F.filter(current, lambda v: (v["in_force_since"] == latest[v_since]) & (-v["vord"] == latest[v_rank])), F.lit(0))
    return F.when(expired_on.isNull() | (expired_on > day), chosen)


v_since, v_rank = "in_force_since", "col2"


def after_approval(blocks: DataFrame) -> DataFrame:
    """Blocks after the heading that opens an approved text, or all blocks of norms without one."""
    opens = F.col("block_type").eqNullSafe("encabezado") & normalize_latin(F.col("title")).isin(*APPROVED_TEXT)
    start = F.min(F.when(opens, F.col("ord"))).over(Window.partitionBy("norm_id"))
    return blocks.withColumn("__start", start).where(F.col("ord") > F.coalesce("__start", F.lit(-1))).drop("__start")


def in_scope(blocks: DataFrame, norms: DataFrame) -> DataFrame:
    """Blocks from ``from_block`` up to, not including, ``until_block``, and the extra blocks; all where a norm has no scope.

    A block that the scope names and the text lacks is an error. The places of the named blocks are found by a join, so that a norm's
    blocks need not come together, and what a row carries of them is as long as its scope.
    """
    needed = F.concat(F.array("scope.from_block", "scope.until_block"), F.coalesce("scope.extra_blocks", F.array().cast("array<string>")))
    named = norms.where("scope is not null").select("norm_id", F.explode(needed).alias("block_id")).distinct()
    places = blocks.select("norm_id", "block_id", "ord").join(named, ["norm_id", "block_id"]).groupBy("norm_id", "block_id").agg(F.min("ord").alias("at"))
    places = places.groupBy("norm_id").agg(F.map_from_entries(F.collect_list(F.struct("block_id", "at"))).alias("__at"))
    scopes = norms.select("norm_id", "scope").join(places, "norm_id", "left")
    lacking = F.array_except(needed, F.coalesce(F.map_keys("__at"), F.array().cast("array<string>")))
    scopes = scopes.select(
        "norm_id", "scope", F.try_element_at("__at", F.col("scope.from_block")).alias("__from"), F.try_element_at("__at", F.col("scope.until_block")).alias("__until"),
        F.when(F.col("scope").isNotNull(), lacking).alias("__lacking"),
    )
    scoped = blocks.join(scopes, "norm_id")
    inside = F.col("scope").isNull() | ((F.col("ord") >= F.col("__from")) & (F.col("ord") < F.col("__until"))) | F.coalesce(F.array_contains("scope.extra_blocks", F.col("block_id")), F.lit(False))
    wrong = F.concat("norm_id", F.lit(": scope block not found in the text: "), F.array_join("__lacking", ", "))
    keep = F.when(F.size("__lacking") > 0, F.raise_error(wrong).cast("boolean")).otherwise(inside)
    return scoped.where(keep).drop("scope", "__from", "__until", "__lacking")


def next_scheduled_change(blocks: DataFrame, norms: DataFrame, day: date) -> DataFrame:
    """(norm_id, next_change): the first later day on which a block in scope changes or expires; null if none."""
    dates = F.concat(F.transform("versions", lambda v: v["in_force_since"]), F.array("expired_on"))
    coming = in_scope(after_approval(blocks), norms).select("norm_id", F.array_min(F.filter(dates, lambda d: d > F.lit(day))).alias("d"))
    return norms.select("norm_id").join(coming.groupBy("norm_id").agg(F.min("d").alias("next_change")), "norm_id", "left")


def hierarchy(rows: DataFrame, key: str, order: str, level: Column, heading: Column, clears: Column, out: str = "hierarchy") -> DataFrame:
    """Headings in effect at each row, outermost first, as an array.

    A heading ends all headings of its level and inside it; a clearing row ends all. Running maxima per level replace the
    stack: a level's last heading holds if it came after the last heading of every outer level and the last clearing row.
    """
    until_now = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumns({"__level": level, "__heading": heading, "__clears": clears})
    last = {f"__l{k}": F.max(F.when(F.col("__level") == k, F.struct(F.col(order).alias("at"), F.col("__heading").alias("h")))).over(until_now) for k in LEVELS}
    marked = marked.withColumns(last | {"__cleared": F.max(F.when(F.col("__clears"), F.col(order))).over(until_now)})
    entries, outer = [], [F.col("__cleared")]
    for k in LEVELS:
        at = F.col(f"__l{k}.at")
        alive = at.isNotNull()
        for other in outer:
            alive &= other.isNull() | (at > other)
        entries.append(F.when(alive, F.col(f"__l{k}.h")))
        outer.append(at)
    stack = F.filter(F.array(*entries), lambda h: h.isNotNull())
    return marked.withColumn(out, stack).drop("__level", "__heading", "__clears", "__cleared", *last)


def heading_text(title: Column, lines: Column) -> Column:
    """"CAPÍTULO I. Objeto": first line, then the others after a full stop; the title if there are no lines."""
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " ")
    joined = F.regexp_replace(F.concat(lines[0], F.lit(". "), rest), r"[. ]+$", "")
    return F.when(F.coalesce(F.size(lines), F.lit(0)) < 1, title).when(F.size(lines) == 1, F.get(lines, F.lit(0))).otherwise(joined)


def rubric(label: Column, line: Column) -> Column:
    """What follows the label in its line, without the punctuation around it; null if nothing or another text does."""
    rest = F.regexp_replace(F.substr(line, F.length(label) + 1), r"^[ .:\-–]+|[ .:\-–]+$", "")
    return F.when(normalize_latin(line).startswith(normalize_latin(label)) & (rest != ""), rest)


def annex(label: Column, paragraphs: Column) -> tuple[Column, Column]:
    """(heading, remaining paragraphs): leading headings that repeat the label are dropped, the first other one is the rubric."""
    repeats = lambda p: (p["kind"] == "heading") & ((normalize_latin(p["text"]) == normalize_latin(label)) | normalize_latin(p["text"]).isin("anexo", "anejo"))
    indexed = F.transform(paragraphs, lambda p, i: F.struct(i.alias("i"), repeats(p).alias("r")))
    first = F.coalesce(F.get(F.filter(indexed, lambda x: ~x["r"]), F.lit(0))["i"], F.size(paragraphs))
    found = F.get(paragraphs, first)
    is_heading = F.coalesce(found["kind"] == "heading", F.lit(False))
    start = first + F.when(is_heading, 2).otherwise(1)
    return F.when(is_heading, found["text"]), F.slice(paragraphs, start, F.greatest(F.size(paragraphs) - start + 1, F.lit(0)))


def is_repealed(paragraphs: Column, line: Column) -> Column:
    """Status in the label's line where there is no text, or a single short text that is a status."""
    body = F.filter(paragraphs, lambda p: p["kind"] == "text")
    only = F.get(body, F.lit(0))["text"]
    in_label = (F.size(body) == 0) & F.coalesce(line.rlike(REPEALED_LABEL), F.lit(False))
    return in_label | F.coalesce((F.size(body) == 1) & only.rlike(REPEALED) & (F.length(only) < REPEALED_MAX), F.lit(False))


def build_provisions(blocks: DataFrame, norms: DataFrame, block_index: DataFrame, day: date) -> DataFrame:
    """Provisions in force on ``day``, one row each, with hierarchy, number, rubric, paragraphs and flags."""
    rows = in_scope(after_approval(blocks), norms).where(~F.coalesce("block_type", F.lit("")).isin(*SKIPPED_TYPES))
    rows = rows.withColumn("v", version_in_force(F.col("versions"), F.col("expired_on"), F.lit(day))).drop("versions").where("v is not null")
    rows = rows.withColumns({"kind": provision_kind(F.col("title")), "level": heading_level(F.col("title"))})
    heading = F.col("block_type").isin(*HEADING_TYPES) | (F.col("kind").isNull() & F.col("level").isNotNull())
    rows = rows.withColumn("is_heading", F.coalesce(heading, F.lit(False)) & ~F.col("kind").eqNullSafe("anexo"))
    level = F.when(F.col("is_heading"), F.col("level"))
    rows = hierarchy(rows, "norm_id", "ord", level, heading_text(F.col("title"), F.col("v.heading_lines")), ~F.col("is_heading") & ~F.col("kind").eqNullSafe("articulo"))
    rows = rows.where(~F.col("is_heading")).withColumn("kind", F.coalesce("kind", F.lit("anexo")))
    rows = rows.withColumn("label", F.coalesce(F.nullif("title", F.lit("")), "v.label_line", "block_id"))
    annex_heading, annex_rest = annex(F.col("label"), F.col("v.paragraphs"))
    is_annex = F.col("kind") == "anexo"
    rows = rows.withColumn("heading", F.when(is_annex, annex_heading).otherwise(rubric(F.col("label"), F.col("v.label_line"))))
    rows = rows.withColumn("paragraphs", F.when(is_annex, annex_rest).otherwise(F.col("v.paragraphs")))
    amending = (F.col("kind") == "disposicion_final") & F.coalesce(normalize_latin(F.col("heading")).rlike(AMENDING), F.lit(False))
    rows = rows.where(~amending).join(block_index.select("norm_id", "block_id", "updated_at"), ["norm_id", "block_id"], "left")
    return rows.select(
        "norm_id", "ord", "block_id", "kind", "label", F.when(~is_annex, provision_number(F.col("label"))).alias("number"), "heading", "hierarchy", "paragraphs",
        F.col("v.in_force_since").alias("version_in_force_since"), F.coalesce("updated_at", "v.in_force_since").alias("block_updated_at"),
        is_repealed(F.col("paragraphs"), F.col("v.label_line")).alias("repealed"), F.col("v.notes").alias("amendment_notes"),
    )


def norm_statistics(norms: DataFrame, provisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per norm: provisions by kind, repealed ones, chunks and the longest chunk; a norm without provisions is an error."""
    kinds = sorted(set(KINDS.values()))
    counted = provisions.groupBy("norm_id").agg(F.count("*").alias("provisions"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count_if("repealed").alias("repealed"), F.max("block_updated_at").alias("consolidated_as_of"))
    sizes = chunks.groupBy("norm_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))
    found = norms.select("norm_id").join(counted, "norm_id", "left").join(sizes, "norm_id", "left")
    some = F.when(F.col("provisions").isNull(), F.raise_error(F.concat("norm_id", F.lit(": no provisions in force"))).cast("bigint")).otherwise(F.col("provisions"))
    return found.withColumn("provisions", some)
