"""From hits to answers: sources, warnings, abstention, prompts, events, their fold, costs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sentences that answers and readers rely on.
ABSTENTION = "No consta en la normativa indexada."
WARNINGS = {"refusal": "El modelo ha declinado responder.", "max_tokens": "La respuesta se ha truncado."}
FAILED = "Error al generar la respuesta."
WARNING_CODES = {"refusal": "refusal", "max_tokens": "truncated"}
NOT_YET = " no se aplica hasta el "
CONSOLIDATED, NOT_APPLICABLE, REPEALED = "texto consolidado a ", "AÚN NO APLICABLE: se aplica desde ", "DEROGADO o sin contenido"
TODAY, QUESTION = "Fecha de hoy: ", "Pregunta: "
CRUMB = " › "

#: What a model is told before the sources; a deployment may say it otherwise.
INSTRUCTIONS = (
    "Contesta en español, con claridad y solo con lo que dicen los fragmentos dados. Cita la norma, el artículo o la disposición y, si consta, el apartado. "
    f'Si los fragmentos no contienen la respuesta, contesta "{ABSTENTION}". Advierte de lo que aún no es aplicable y de lo derogado. No des asesoramiento jurídico.'
)

BATCH = 64

EVENT = "query_id long, seq int, type string, text string, source_index int, code string, stop_reason string, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long"
Generate = Callable[[str, list[dict]], Iterator[dict]]


def sources(hits: DataFrame, day, rank_col: str = "rank") -> DataFrame:
    """``hits`` with index from 0, rounded score and whether the norm does not apply yet on ``day``."""
    later = F.coalesce(F.col("application_date") > F.lit(day), F.lit(False))
    return hits.withColumns({"index": F.col(rank_col) - 1, "score": F.round("score", 4), "not_yet_applicable": later}).withColumnRenamed("sources", "retrieved_by")


def applicability_warnings(found: DataFrame) -> DataFrame:
    """(query_id, index, code, message) of the ``sources``, with a ``citation``, that do not apply yet."""
    message = F.concat("citation", F.lit(NOT_YET), F.date_format("application_date", "yyyy-MM-dd"), F.lit("."))
    return found.where("not_yet_applicable").select("query_id", "index", F.lit("not_yet_applicable").alias("code"), message.alias("message"))


def abstentions(queries: DataFrame, hits: DataFrame, threshold: float | None, query_col: str = "query_id") -> DataFrame:
    """(query, abstain): no hits, or the best reranked score is below ``threshold``; unreranked hits alone never abstain."""
    best = F.max(F.when(F.array_contains("sources", "rerank"), F.col("score"))).alias("best")
    seen = queries.select(query_col).distinct().join(hits.groupBy(query_col).agg(F.count("*").alias("n"), best), query_col, "left")
    low = F.lit(False) if threshold is None else F.coalesce(F.col("best") < threshold, F.lit(False))
    return seen.select(query_col, (F.col("n").isNull() | low).alias("abstain"))


def result_title(citation: Column, heading: Column, consolidated: Column, application: Column, repealed: Column, day) -> Column:
    show = lambda d: F.date_format(d, "yyyy-MM-dd")
    notes = F.concat_ws("; ", F.concat(F.lit(CONSOLIDATED), show(consolidated)), F.when(application > F.lit(day), F.concat(F.lit(NOT_APPLICABLE), show(application))), F.when(repealed, F.lit(REPEALED)))
    return F.concat(citation, F.coalesce(F.concat(F.lit(" — "), F.nullif(heading, F.lit(""))), F.lit("")), F.lit(" ("), notes, F.lit(")"))


def context_block(short_name: Column, levels: Column, label: Column, text: Column, url: Column, title: Column, citations: bool = True) -> Column:
    """A result: a breadcrumb, then a text block for every line that is not blank; ``citations`` lets a model cite its blocks."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    content = F.concat(F.array(F.concat_ws(CRUMB, short_name, levels, label)), F.when(F.size(lines) > 0, lines).otherwise(F.array(text)))
    return F.struct(F.lit("search_result").alias("type"), url.alias("source"), title.alias("title"), F.transform(content, lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content"), F.struct(F.lit(citations).alias("enabled")).alias("citations"))


def prompts(queries: DataFrame, hits: DataFrame, day, query_col: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query, prompt): instructions, blocks of the hits in rank order and the dated question, as JSON. ``hits`` hold a ``block`` and
    a ``rank``."""
    blocks = hits.groupBy(query_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]).alias("blocks"))
    question = F.concat(F.lit(TODAY), F.lit(str(day)), F.lit(".\n\n" + QUESTION), F.col(query_text))
    return queries.join(blocks, query_col, "left").select(query_col, F.to_json(F.struct(F.lit(INSTRUCTIONS).alias("system"), "blocks", question.alias("question"))).alias("prompt"))


def extractive(prompt: str, found: list[dict]) -> Iterator[dict]:
    """Stand-in for a language model: the first source's first line, cited."""
    if found:
        line = next((x for x in found[0]["text"].split("\n") if x.strip()), "")
        yield {"type": "delta", "text": line}
        yield {"type": "citation", "text": line, "source_index": 0}
    yield {"type": "completed", "stop_reason": "end_turn", "model": "extractive", "input_tokens": len(prompt) // 4, "output_tokens": len(found)}


def _answered(query_id: int, prompt: str, abstain: bool, found: list[dict], model: Generate) -> Iterator[dict]:
    """Events of one question. What a model raises ends its own question with an "error" event; its earlier events stay."""
    if abstain:
        yield {"query_id": query_id, "seq": 0, "type": "delta", "text": ABSTENTION}
        yield {"query_id": query_id, "seq": 1, "type": "completed"}
        return
    seq = 0
    try:
        for event in model(prompt, found):
            yield {"query_id": query_id, "seq": seq, **event}
            seq += 1
    except Exception as error:  # any failure of a model, of which nothing is known here
        yield {"query_id": query_id, "seq": seq, "type": "error", "text": f"{type(error).__name__}: {error}"}


def generate(asked: DataFrame, model: Generate = extractive) -> DataFrame:
    """Event rows of ``asked`` (query_id, prompt, abstain, sources array<struct<index,text>>), in batches of a few events, so that none
    waits for the end of its partition. Abstaining queries never reach the model; a failing call costs its own question only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in EVENT.split(", ")]

        def out(rows: list[dict]) -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=names, dtype=object)
            for c in ("source_index", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"):
                frame[c] = pd.to_numeric(frame[c]).astype("Int64")
            return frame

        rows: list[dict] = []
        for frame in frames:
            for r in frame.itertuples():
                found = [x if isinstance(x, dict) else x.asDict() for x in ([] if r.sources is None else r.sources)]
                rows.extend(_answered(r.query_id, r.prompt, r.abstain, found, model))
                if len(rows) >= BATCH:
                    yield out(rows)
                    rows = []
        yield out(rows)

    return asked.mapInPandas(run, EVENT)


def in_range(events: DataFrame, n_sources: DataFrame) -> DataFrame:
    """``events`` without citations of sources that were not given. ``n_sources`` is (query_id, n)."""
    joined = events.join(n_sources, "query_id", "left")
    good = (F.col("type") != "citation") | F.col("source_index").between(0, F.coalesce("n", F.lit(0)) - 1)
    return joined.where(good).drop("n")


def fold_events(events: DataFrame, query_col: str = "query_id") -> DataFrame:
    """One row per query: answer, cited sources, whether it abstains in words, warnings, stop reason, usage, and the error, if any,
    that ended it."""
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", "text")))), lambda x: x["text"])
    last = lambda c: F.max_by(F.when(F.col("type") == "completed", F.col(c)), F.when(F.col("type") == "completed", F.col("seq")))
    columns = ["stop_reason", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
    folded = events.groupBy(query_col).agg(F.trim(F.array_join(texts, "")).alias("answer"), F.array_sort(F.collect_set(F.when(F.col("type") == "citation", F.col("source_index")))).alias("cited_sources"), F.max(F.when(F.col("type") == "error", F.col("text"))).alias("error"), *[last(c).alias(c) for c in columns])
    code = F.create_map(*[F.lit(x) for pair in WARNING_CODES.items() for x in pair])
    return folded.withColumn("abstained", F.col("answer").startswith(ABSTENTION.rstrip("."))).withColumn("warning", F.when(F.col("stop_reason").isNotNull(), F.try_element_at(code, F.col("stop_reason"))))


def costs(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """``usage`` with ``cost_usd``: tokens at prices per million; null for a model without a price."""
    amount = sum((F.coalesce(F.col(t), F.lit(0)) * F.col(f"p.{p}") for t, p in (("input_tokens", "input"), ("output_tokens", "output"), ("cache_read_tokens", "cache_read"), ("cache_write_tokens", "cache_write"))), F.lit(0.0))
    joined = usage.alias("u").join(pricing.alias("p"), F.col("u.model") == F.col("p.model"), "left")
    return joined.select("u.*", F.round(amount / 1e6, 6).alias("cost_usd"))


def server_sent(kind: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def cited_and_uncited(found: DataFrame, folded: DataFrame) -> DataFrame:
    """``found`` with ``cited``: whether the answer cites the source."""
    cited = folded.select("query_id", F.explode("cited_sources").alias("index"), F.lit(True).alias("__cited"))
    return found.join(cited, ["query_id", "index"], "left").withColumn("cited", F.coalesce("__cited", F.lit(False))).drop("__cited")


def event_stream(found: DataFrame, events: DataFrame) -> DataFrame:
    """(query_id, seq, type, data) of every question, data as JSON: its sources, warnings of what does not apply yet, the model's
    deltas and citations, a warning if it refused or was cut off, and its end: "done", or "error" if the model failed. ``found`` are ``sources`` with a ``citation``."""
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "chunk_id", "citation", "score", "retrieved_by", "not_yet_applicable"))).alias("s"))
    first = events.select("query_id").distinct().join(listed, "query_id", "left")
    none = F.array().cast(listed.schema["s"].dataType)
    row = lambda part, at, kind, data: [F.lit(part).alias("part"), at.cast("int").alias("at"), kind.alias("type"), F.to_json(data).alias("data")]
    zero = F.lit(0)
    parts = [
        first.select("query_id", *row(0, zero, F.lit("sources"), F.struct(F.coalesce("s", none).alias("sources")))),
        applicability_warnings(found).select("query_id", *row(1, F.col("index"), F.lit("warning"), F.struct("code", "message", "index"))),
        events.where("type = 'delta'").select("query_id", *row(2, F.col("seq"), F.lit("delta"), F.struct("text"))),
        events.where("type = 'citation'").select("query_id", *row(2, F.col("seq"), F.lit("citation"), F.struct(F.col("source_index").alias("index"), F.col("text").alias("cited_text")))),
    ]
    end = events.where("type = 'completed'")
    said = F.create_map(*[F.lit(x) for pair in WARNINGS.items() for x in pair])
    code = F.create_map(*[F.lit(x) for pair in WARNING_CODES.items() for x in pair])
    parts.append(end.where(F.col("stop_reason").isin(*WARNINGS)).select("query_id", *row(3, zero, F.lit("warning"), F.struct(F.try_element_at(code, F.col("stop_reason")).alias("code"), F.try_element_at(said, F.col("stop_reason")).alias("message")))))
    parts.append(end.select("query_id", *row(4, zero, F.lit("done"), F.struct("stop_reason", "model", "input_tokens", "output_tokens"))))
    # What went wrong is for the log; readers are told that it did.
    parts.append(events.where("type = 'error'").select("query_id", *row(4, zero, F.lit("error"), F.struct(F.lit(FAILED).alias("message")))))
    seq = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "at", "type")) - 1
    return reduce(DataFrame.unionByName, parts).select("query_id", seq.alias("seq"), "type", "data")
