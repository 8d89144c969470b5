"""Command line: ``python -m lexframe.cli --store DIR --catalog FILE COMMAND``."""

from __future__ import annotations

import argparse
import json
import logging
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import __version__, observability, settings, sinks
from .operators import evaluation, references, retrieval
from .plans.engine import Engine
from .session import session
from .sources import catalog, landing, xml


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    given = settings.load()
    parser = argparse.ArgumentParser(prog="lexframe")
    parser.add_argument("--store", default=given.store, help="folder of the versioned store")
    parser.add_argument("--catalog", default=given.catalog, help="JSON list of norms")
    parser.add_argument("--landing", default=given.landing, help="folder of raw snapshots")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="bring the store up to date")
    ingest.add_argument("--norm", action="append", help="only these norms")
    ingest.add_argument("--dry-run", action="store_true", help="statistics only")
    ingest.add_argument("--force", action="store_true")
    ingest.add_argument("--recreate", action="store_true")
    fetch = commands.add_parser("fetch", help="raw snapshots of the norms that lack some part")
    fetch.add_argument("--service", default=given.service, help="address of the service")
    fetch.add_argument("--refresh", action="store_true")
    fetch.add_argument("--changed", action="store_true", help="also the norms whose index is not the one that was fetched")
    for name in ("search", "ask"):
        command = commands.add_parser(name)
        command.add_argument("query")
        command.add_argument("-k", type=int, default=given.top_k)
        command.add_argument("--norm", action="append", default=[])
        if name == "ask":
            command.add_argument("--log", default=given.query_log, help="folder to which the answer is appended as a JSON line")
            command.add_argument("--events", action="store_true", help="server-sent events instead of the folded answer")
            command.add_argument("--abstain-below", type=float, default=given.abstain_below)
        if name == "search":
            command.add_argument("--mode", choices=("dense", "sparse", "hybrid"), default="hybrid")
    commands.add_parser("norms")
    commands.add_parser("ready")
    validate = commands.add_parser("eval-validate", help="gold provisions that the index lacks")
    run = commands.add_parser("eval", help="retrieval quality by configuration")
    for command in (validate, run):
        command.add_argument("questions", help="JSON lines of id, category, question, gold")
    run.add_argument("--report", help="folder for the summary as JSON lines")
    run.add_argument("--configs", default="dense,sparse,hybrid,hybrid+refs,hybrid+refs+rerank")
    commands.add_parser("version")
    return parser.parse_args(argv)


def _questions(spark, norms, path: str):
    rows = spark.read.schema("id string, category string, question string, gold array<string>").json(path)
    gold = references.parse_gold(rows.select("id", F.explode("gold").alias("ref")), norms)
    return rows.drop("gold"), gold.drop("ref")


def _show(rows: DataFrame) -> None:
    """All rows: one for each norm or gold provision, so no more than a catalog or a list of questions has."""
    held = rows.cache()
    held.show(max(held.count(), 1), False)
    held.unpersist()


def main(argv: list[str] | None = None) -> None:
    args = _arguments(argv)
    if args.command == "version":
        print(__version__)
        return
    observability.log_json(settings.load().log_level)
    spark = session()
    norms = catalog.norms(spark, json.loads(Path(args.catalog).read_text("utf-8")))
    engine = Engine(spark, args.store, norms)
    if args.command == "fetch":
        fetched = landing.fetch_changed(spark, args.landing, norms, args.service) if args.changed and not args.refresh else landing.fetch_snapshots(spark, args.landing, norms, args.service, args.refresh)
        print(fetched)
    elif args.command == "ingest":
        texts = landing.read_text(spark, args.landing).join(norms.select("norm_id"), "norm_id", "left_semi")
        index = landing.parse_index(landing.read_json(spark, args.landing, landing.INDEX))
        chosen = norms.where(F.col("norm_id").isin(args.norm)) if args.norm else None
        if args.norm:
            texts = texts.where(F.col("norm_id").isin(args.norm))
        if args.recreate:
            engine.store.reset("cache")
        blocks = xml.blocks(texts)
        if args.dry_run:
            engine.norms = norms if chosen is None else chosen
            _show(engine.statistics(blocks, index, date.today()).orderBy("norm_id"))
        else:
            _show(engine.sync(blocks, index, date.today(), args.force, chosen).orderBy("norm_id"))
    elif args.command in ("search", "ask"):
        asked = spark.createDataFrame([(0, args.query)], "query_id long, query string")
        chosen = retrieval.ChunkFilter(norm_ids=tuple(args.norm))
        if args.command == "search":
            engine.search(asked, args.k, args.mode, chosen).select("rank", "norm_short_name", "label", "apartado", "score", "sources").orderBy("rank").show(args.k, False)
        elif args.events:
            events = engine.ask_events(asked, date.today(), args.k, chosen, args.abstain_below).orderBy("seq")
            for row in events.select("type", "data").toLocalIterator():
                print(f"event: {row['type']}\ndata: {row['data']}\n")
        else:
            answers = engine.ask(asked, date.today(), args.k, chosen, args.abstain_below).cache()
            answers.select("answer", "cited_sources", "abstained", "cost_usd").show(1, False)
            if args.log:
                try:
                    sinks.append_log(answers.join(asked, "query_id"), args.log)
                except Exception:  # a log that cannot be written must not cost the answer
                    logging.getLogger(__name__).exception("query log")
    elif args.command == "norms":
        _show(engine.overview().select("norm_id", "short_name", "consolidated_as_of", "chunks").orderBy("norm_id"))
    elif args.command == "ready":
        engine.readiness().show()
    elif args.command == "eval-validate":
        _show(evaluation.missing_gold(_questions(spark, norms, args.questions)[1], engine._chunks()))
    else:
        summary = engine.evaluate(*_questions(spark, norms, args.questions), args.configs.split(",")).cache()
        print(evaluation.markdown_table(summary))
        if args.report:
            sinks.write_report(summary, args.report, revision=evaluation.revision() or "unknown", model=engine.embedder.name, written=date.today().isoformat())


if __name__ == "__main__":
    main()
