import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexframe.operators import aliases, answering, dense, evaluation, incremental, lexical, references, retrieval
from lexframe.operators.store import Store
from lexframe.plans.engine import Engine
from lexframe.sources import catalog, xml
from lexframe.streaming import ingest

from .literals import NORMS, XML


@pytest.fixture(scope="module")
def norms(spark):
    return catalog.norms(spark, NORMS).where("ord = 0")


class Counting(dense.HashEmbedder):
    """Counts rows on the driver by what the store holds; the embedder itself is pure."""


def index(spark, day="20210301"):
    return spark.createDataFrame([("N-1", 0, "plazos", "Disposición", date(int(day[:4]), int(day[4:6]), int(day[6:])))], "norm_id string, ord int, block_id string, title string, updated_at date")


@pytest.fixture(scope="module")
def engine(spark, norms, tmp_path_factory):
    prices = spark.createDataFrame([("extractive", 1.0, 2.0, 0.0, 0.0)], "model string, input double, output double, cache_read double, cache_write double")
    built = Engine(spark, str(tmp_path_factory.mktemp("store")), norms, pricing=prices)
    blocks = xml.blocks(spark.createDataFrame([("N-1", XML)], "norm_id string, payload string"))
    report = built.sync(blocks, index(spark), date(2026, 1, 1)).first()
    assert (report["status"], report["reason"], report["changed"]) == ("created", "not indexed", 5)
    return built


def test_incremental_timeline(spark, norms, tmp_path):
    built = Engine(spark, str(tmp_path / "s"), norms)
    blocks = lambda text: xml.blocks(spark.createDataFrame([("N-1", text)], "norm_id string, payload string"))
    sync = lambda text, day, at="20210301", **k: built.sync(blocks(text), index(spark, at), day, **k).first()
    cached = lambda: built.store.read("cache", "text_hash string, model string, vector array<float>").count()
    assert sync(XML, date(2026, 1, 1))["status"] == "created" and cached() == 5
    assert sync(XML, date(2026, 2, 1))["status"] == "skipped"
    row = sync(XML.replace("Diez días", "Once días"), date(2026, 3, 1), "20260301")
    assert (row["status"], row["reason"], row["changed"], row["unchanged"]) == ("updated", "index changed", 1, 4) and cached() == 6
    assert sync(XML, date(2029, 12, 30), "20260301")["status"] == "skipped"
    row = sync(XML.replace("Diez días", "Once días"), date(2029, 12, 31), "20260301")
    assert (row["reason"], row["changed"]) == ("scheduled change", 1) and cached() == 7
    assert sync(XML, date(2030, 1, 3), "20260301", force=True)["reason"] == "forced"
    assert built._chunks().groupBy("chunk_id").count().where("count > 1").count() == 0


def test_overview_and_readiness(engine):
    assert engine.overview().first()["chunks"] == 5 and all(r["ok"] for r in engine.readiness().collect())


def test_search_puts_cited_provisions_first(spark, engine):
    queries = spark.createDataFrame([(1, "¿Qué dice el artículo 1 de la Ley 7/1999?"), (2, "plazo de once días"), (3, "zzz")], "query_id long, query string")
    rows = engine.search(queries, k=3).orderBy("query_id", "rank").collect()
    first = [r for r in rows if r["query_id"] == 1][0]
    assert first["block_id"] == "a1" and first["score"] == 1.0 and first["sources"] == ["reference"]
    assert max(r["rank"] for r in rows) <= 3 and not any(r["repealed"] for r in rows)
    sparse = engine.search(queries, k=3, mode="sparse", use_references=False).collect()
    assert {r["block_id"] for r in sparse if r["query_id"] == 2} == {"plazos"} and not [r for r in sparse if r["query_id"] == 3]
    again = engine.search(queries, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in rows] == [(r["query_id"], r["chunk_id"]) for r in again]


def test_ask(spark, engine):
    queries = spark.createDataFrame([(1, "artículo 1 de la Ley 7/1999"), (2, "otra cosa")], "query_id long, query string")
    rows = {r["query_id"]: r for r in engine.ask(queries, date(2026, 1, 1)).collect()}
    assert rows[1]["sources"][0]["cited"] and rows[1]["sources"][0]["citation"] == "LPX, art. 1" and not any(x["cited"] for x in rows[1]["sources"][1:])
    events = [(r["seq"], r["type"]) for r in engine.ask_events(queries.where("query_id = 1"), date(2026, 1, 1)).orderBy("seq").collect()]
    assert events == [(0, "sources"), (1, "delta"), (2, "citation"), (3, "done")]
    assert rows[1]["answer"] == "Texto actual." and rows[1]["cited_sources"] == [0] and rows[1]["cost_usd"] > 0 and not rows[1]["abstained"]
    none = retrieval.ChunkFilter(norm_ids=("none",))
    row = engine.ask(queries.where("query_id = 2"), date(2026, 1, 1), chunk_filter=none).first()
    assert row["abstained"] and row["answer"] == answering.ABSTENTION and row["cost_usd"] is None
    with pytest.raises(Exception, match="3 to 2000"):
        engine.ask(spark.createDataFrame([(1, "x")], "query_id long, query string"), date(2026, 1, 1)).collect()


def test_evaluate(spark, engine):
    questions = spark.createDataFrame([("q1", "literal", "artículo 1 de la Ley 7/1999"), ("q2", "out_of_scope", "nada")], "id string, category string, question string")
    gold = spark.createDataFrame([("q1", "N-1", "articulo", "1", None)], "id string, norm_id string, kind string, number string, block_id string")
    rows = {(r["config"], r["category"]): r for r in engine.evaluate(questions, gold, ["hybrid+refs", "sparse+rerank"]).collect()}
    assert rows["hybrid+refs", "overall"]["recall_at_1"] == 1.0 and rows["hybrid+refs", "literal"]["mrr"] == 1.0 and rows["hybrid+refs", "overall"]["n"] == 1
    assert "| config | category |" in evaluation.markdown_table(engine.evaluate(questions, gold, ["sparse"]))
    with pytest.raises(Exception, match="duplicate question id"):
        evaluation.checked_questions(questions.union(questions), gold).collect()


def test_grid_searches_each_branch_once(spark, engine, monkeypatch):
    configs = ["dense", "sparse", "hybrid", "hybrid+refs+rerank", "dense+refs"]
    queries = spark.createDataFrame([(1, "¿Qué dice el artículo 1 de la Ley 7/1999?"), (2, "plazo de once días"), (3, "zzz"), (4, None)], "query_id long, query string")
    vectors = dense.embed(queries, engine.embedder, "query_id", "query").withColumnRenamed("vector", "query_vector")
    calls = []
    for module, name in ((lexical, "search_postings"), (dense, "search")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real, name=name, **k: calls.append(name) or real(*a, **k))
    held = engine.store.read("vectors", "norm_id string, block_id string, chunk_id string, vector array<float>")
    postings = engine.store.parts("postings", "norm_id string, block_id string, chunk_id string, n_terms int, term string, tf long")
    grid = retrieval.retrieve_grid(engine._chunks(), queries.join(vectors, "query_id"), engine.norms, configs, 3, held, retrieval.lexical_overlap, postings, engine.store.keep)
    found = {tuple(r) for r in grid.select("config", "query_id", "rank", "chunk_id", "score", F.concat_ws(",", F.array_sort("sources"))).collect()}
    assert sorted(calls) == ["search", "search_postings"]
    for config in configs:
        mode, *switches = config.split("+")
        alone = engine.search(queries, 3, mode, None, "refs" in switches, retrieval.lexical_overlap if "rerank" in switches else None)
        rows = alone.select(F.lit(config), "query_id", "rank", "chunk_id", "score", F.concat_ws(",", F.array_sort("sources"))).collect()
        assert {tuple(r) for r in rows} == {r for r in found if r[0] == config}, config
    with pytest.raises(ValueError, match="no such mode"):
        retrieval.retrieve_grid(engine._chunks(), queries, engine.norms, ["nearest"], 3, held, None, postings, engine.store.keep)


def test_a_failing_model_costs_its_own_question_only(spark, engine):
    def model(prompt, found):
        yield {"type": "delta", "text": "Sí."}
        if "once" in prompt:
            raise RuntimeError("down")
        yield {"type": "completed", "stop_reason": "end_turn", "model": "m", "input_tokens": 1, "output_tokens": 1}

    own = Engine(spark, engine.store.root, engine.norms, generate=model)
    queries = spark.createDataFrame([(1, "plazo de once"), (2, "materia de las pruebas")], "query_id long, query string")
    rows = {r["query_id"]: r for r in own.ask(queries, date(2026, 1, 1)).collect()}
    assert rows[1]["error"] == "RuntimeError: down" and rows[1]["answer"] == "Sí." and rows[1]["stop_reason"] is None
    assert rows[2]["error"] is None and rows[2]["stop_reason"] == "end_turn"
    told = own.ask_events(queries, date(2026, 1, 1)).orderBy("query_id", "seq").collect()
    assert [r["type"] for r in told if r["query_id"] == 1][-2:] == ["delta", "error"] and [r["type"] for r in told if r["query_id"] == 2][-1] == "done"
    assert all("down" not in r["data"] for r in told)


def test_questions_are_answered_as_they_come(spark, engine, tmp_path):
    import json

    from lexframe.streaming import answers

    asked, out = tmp_path / "asked", str(tmp_path / "out")
    asked.mkdir()

    def ask(name, *rows):
        (asked / name).write_text("\n".join(json.dumps({"query_id": i, "query": q}) for i, q in rows))
        answers.answer(engine, str(asked), out, str(tmp_path / "seen"), lambda: date(2026, 1, 1)).awaitTermination()
        return {(r["query_id"], r["seq"]): r["type"] for r in spark.read.parquet(out).collect()}

    first = ask("a.json", (1, "plazo de once días"), (2, "x"))
    assert first[1, 0] == "sources" and first[2, 0] == "error" and "done" in first.values()
    second = ask("b.json", (1, "otra vez lo mismo"), (3, None))
    assert {k: v for k, v in second.items() if k[0] != 3} == first and second[3, 0] == "error"
    assert spark.read.parquet(out).groupBy("query_id", "seq").count().where("count > 1").isEmpty()


def test_recall_example(spark):
    gold = spark.createDataFrame([("q", 20), ("q", 9)], "id string, gold int")
    hits = spark.createDataFrame([("q", 1, 1), ("q", 20, 2), ("q", 3, 3), ("q", 9, 4)], "id string, gold int, rank int")
    row = evaluation.score_questions(gold, hits, "id", (1, 3, 5)).first()
    assert (row["recall_at_1"], row["recall_at_3"], row["recall_at_5"], row["reciprocal_rank"]) == (0.0, 0.5, 1.0, 0.5)


def test_gold_grammar(spark, norms):
    refs = spark.createDataFrame([("LPX art. 20",), ("LPX anexo an",), ("LPX DA 13",)], "ref string")
    rows = {r["ref"]: r for r in evaluation_parse(refs, norms)}
    assert rows["LPX art. 20"]["number"] == "20" and rows["LPX anexo an"]["block_id"] == "an" and rows["LPX DA 13"]["kind"] == "disposicion_adicional"
    with pytest.raises(Exception, match="gold reference"):
        references.parse_gold(spark.createDataFrame([("XX art. 2",)], "ref string"), norms).collect()


def evaluation_parse(refs, norms):
    return references.parse_gold(refs, norms).collect()


@pytest.mark.parametrize(
    "text, found",
    [
        ("el artículo 18 de la Ley 7/1999", [("articulo", "18", None, "N-1")]),
        ("arts. 3 bis y el art. 20.4 del Real Decreto 8/2001", [("articulo", "3 bis", None, None), ("articulo", "20", "4", "N-2")]),
        ("la D.A. tercera de la LPX", [("disposicion_adicional", "3", None, "N-1")]),
        ("disposición transitoria 4.ª del RDX", [("disposicion_transitoria", "4", None, "N-2")]),
        ("nos da un plazo, ver Ley 7/1999", []),
    ],
)
def test_references(spark, text, found):
    catalog_df = catalog.norms(spark, NORMS)
    rows = references.references(spark.createDataFrame([(1, text)], "id long, t string"), catalog_df, "id", "t").orderBy("ref").collect()
    assert [(r["kind"], r["number"], r["apartado"], r["norm_id"]) for r in rows] == found


def test_norms_in_order_of_alias_length(spark):
    rows = [(1, "La LPX y el Real Decreto 8/2001; Ley 7/19999"), (2, None), (3, "xLPX LPX/ /LPX _LPX"), (4, "xLPX (LPX)")]
    texts, norms = spark.createDataFrame(rows, "id long, t string"), catalog.norms(spark, NORMS)
    for block in (aliases.BLOCK_CHARS, 10):  # all at once, and alias by alias
        found = {r["id"]: r["norms"] for r in aliases.mentioned_norms(texts, norms, "id", "t", block).collect()}
        assert found == {1: ["N-2", "N-1"], 2: [], 3: [], 4: ["N-1"]}


def test_aliases_of_one_run_are_no_part_of_the_automaton(spark):
    """They lie in a table; both ways find what a plain search of free places finds, norms of the same alias included."""
    names = ["lpx", "7/1999", "ley 7/1999", "ley", "(a)", "a_b", "b c", "lpx"]
    norms = catalog.norms(spark, [{"norm_id": f"N-{i}", "short_name": n, "aliases": [], "topics": []} for i, n in enumerate(names)])
    known = aliases.automata(norms)
    assert len(known) == 1 and len(known[0]._built()) == 3 and len(known[0].sent.value["hashes"]) == 5
    inside = "[A-Za-z0-9_/]"
    for text in ("ley 7/1999 y lpx, lpx", "xley (a) a_b b c", "7/1999/ ley 7/19999 b cc", "a_b_ (a)(a) /lpx lpx", "", "ley"):
        plain = {i: m.start() + 1 for i, n in enumerate(names) if (m := re.search(f"(?<!{inside}){re.escape(n)}(?!{inside})", text))}
        assert {int(norm[2:]): place for place, _, norm in known[0].places(text)} == plain


def test_references_take_the_first_norm_over_blocks_of_aliases(spark, monkeypatch):
    text = spark.createDataFrame([(1, "el articulo 3 de la Ley 7/1999 y del Real Decreto 8/2001, el articulo 4 del Real Decreto 8/2001"), (2, None)], "id long, t string")
    one = lambda: sorted(map(tuple, references.references(text, catalog.norms(spark, NORMS), "id", "t").collect()))
    whole = one()
    assert [(r[3], r[5]) for r in whole] == [("3", "N-1"), ("4", "N-2")]
    known = aliases.automata(catalog.norms(spark, NORMS), 10)
    monkeypatch.setattr(references.aliases, "automata", lambda _: known)
    assert len(known) > 2 and one() == whole


def test_bm25_saturates(spark):
    docs = spark.createDataFrame([(1, "seguro " * 50), (2, "seguro"), (3, "")], "id long, t string")
    weights = {(r["id"], r["term"]): r["weight"] for r in lexical.document_weights(docs, "id", "t").collect()}
    assert 0 < weights[2, "seguro"] and weights[1, "seguro"] < lexical.K1 + 1
    vectors = lexical.sparse_vectors(lexical.document_weights(docs, "id", "t"), "id").collect()
    assert all([x["term_id"] for x in r["vector"]] == sorted(x["term_id"] for x in r["vector"]) for r in vectors)


def test_dense_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = sorted(map(tuple, dense.search(vectors, queries, 4).collect()))
    monkeypatch.setattr(dense, "BLOCK_FLOATS", 16)
    assert sorted(map(tuple, dense.search(vectors, queries, 4).collect())) == whole and len(whole) == 28
    with pytest.raises(Exception, match="expected 9 dimensions"):
        dense.check_dimension(vectors, 9, "embedding").collect()


def test_abstention_needs_reranked_hits(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    hits = spark.createDataFrame([(1, 0.2, ["sparse", "rerank"]), (2, 0.1, ["reference"])], "query_id long, score double, sources array<string>")
    assert {r[0]: r[1] for r in answering.abstentions(queries, hits, 0.5).collect()} == {1: True, 2: False, 3: True}
    assert {r[0]: r[1] for r in answering.abstentions(queries, hits, None).collect()} == {1: False, 2: False, 3: True}


def test_out_of_range_citations_and_warnings(spark):
    events = spark.createDataFrame([(1, 0, "delta", "a", None, None), (1, 1, "citation", "a", 5, None), (1, 2, "citation", "a", 0, None), (1, 3, "completed", None, None, "max_tokens")], "query_id long, seq int, type string, text string, source_index int, stop_reason string")
    events = events.withColumns({"model": F.lit("m")} | {c: F.lit(1) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")})
    kept = answering.in_range(events, spark.createDataFrame([(1, 2)], "query_id long, n int"))
    row = answering.fold_events(kept).first()
    assert row["cited_sources"] == [0] and row["warning"] == "truncated" and row["answer"] == "a"


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "x"))
    rows = spark.range(1)
    store._claim(1)
    with pytest.raises(RuntimeError, match="version 1"):
        store.commit(t=rows)
    store.release()
    assert store.commit(t=rows) == 1
    with pytest.raises(Exception, match="never"):
        store.commit(t=rows.select(F.raise_error(F.lit("never")).alias("a")))
    assert store.commit(t=rows) == 2


def test_store_reads_one_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "x"))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "a int")
    assert store.read("t", "a int").count() == 0
    store.commit(t=rows(1), u=rows(9))
    store.commit(t=incremental.upsert(store.read("t", "a int"), rows(2), ["a"]))
    assert sorted(r[0] for r in store.read("t", "a int").collect()) == [1, 2] and store.read("u", "a int").count() == 1
    store.reset("u")
    assert store.read("t", "a int").count() == 0 and store.read("u", "a int").count() == 1


def test_streaming_ingest(spark, tmp_path):
    folder = tmp_path / "raw" / "N-1"
    folder.mkdir(parents=True)
    (folder / "texto.xml").write_text(XML, "utf-8")
    (folder / "indice.json").write_text('{"status":{"code":"200"},"data":{"bloque":[{"id":"a1","titulo":"x","fecha_actualizacion":"20210301"}]}}', "utf-8")
    seen = []
    for _ in range(2):
        query = ingest.watch(spark, str(tmp_path / "raw"), str(tmp_path / "cp"), lambda b, i, d: seen.append((b.count(), i.count())))
        query.awaitTermination(120)
    assert seen == [(6, 1)]


def test_scheduled_changes_wake_a_norm(spark, tmp_path):
    """The clock: 31 December 2029, a change of N-1's text, is moved to a few seconds from now."""
    import time

    for norm, text in (("N-1", XML), ("N-2", XML.replace("20291231", "20000103"))):
        (tmp_path / "raw" / norm).mkdir(parents=True)
        (tmp_path / "raw" / norm / "texto.xml").write_text(text, "utf-8")
        (tmp_path / "raw" / norm / "indice.json").write_text('{"status":{"code":"200"},"data":{"bloque":[{"id":"a1","titulo":"x","fecha_actualizacion":"20210301"}]}}', "utf-8")
    seen, at = [], int(time.time() * 1000) + 40_000
    wake = lambda day, at=at: at if day == date(2029, 12, 31) else 0

    def sync(blocks, index, day, only):
        seen.append((sorted(r[0] for r in only.collect()), time.time() * 1000 >= at, blocks.select("norm_id").distinct().count(), index.count()))

    start = lambda: ingest.watch_scheduled(spark, str(tmp_path / "raw"), str(tmp_path / "cp"), sync, every="1 second", wake=wake)

    def until(n):
        query, end = start(), time.time() + 90
        try:
            while len(seen) < n and time.time() < end and query.isActive:
                time.sleep(0.5)
            assert query.exception() is None
        finally:
            query.stop()

    until(1)
    assert seen == [(["N-1", "N-2"], False, 2, 2)]
    until(2)  # the timer outlives a restart
    assert seen[1:] == [(["N-1"], True, 1, 1)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ingest.ROCKS


def test_unfetched_norm_and_failed_sync_change_nothing(spark, engine):
    before = engine._chunks().count()
    none = xml.blocks(spark.createDataFrame([], "norm_id string, payload string"))
    assert engine.sync(none, index(spark, "20260401"), date(2026, 1, 1)).first()["status"] == "skipped" and engine._chunks().count() == before
    version = engine.store.versions()[-1]
    changed = xml.blocks(spark.createDataFrame([("N-1", XML.replace("Diez", "Doce"))], "norm_id string, payload string"))
    embedder = engine.embedder

    class Broken:
        name = embedder.name

        def __call__(self, texts):
            raise ValueError("no model")

    engine.embedder = Broken()
    with pytest.raises(Exception, match="no model"):
        engine.sync(changed, index(spark, "20260401"), date(2026, 1, 1))
    engine.embedder = embedder
    assert engine.store.versions()[-1] == version and engine._chunks().count() == before


def test_settings_and_log(tmp_path, capsys):
    import json
    import logging

    from lexframe import observability, settings

    (tmp_path / ".env").write_text("# comment\nexport LEXFRAME_TOP_K=5\nLEXFRAME_STORE='/a b'\n", "utf-8")
    found = settings.load({"LEXFRAME_TOP_K": "6", "LEXFRAME_ABSTAIN_BELOW": "0.25"}, tmp_path / ".env")
    assert (found.top_k, found.store, found.abstain_below, found.max_chars) == (6, "/a b", 0.25, 3200)
    observability.log_json()
    logging.getLogger("lexframe.x").info("done", extra={"n": 3})
    line = json.loads(capsys.readouterr().err)
    assert (line["event"], line["n"], line["level"]) == ("done", 3, "info")
    timings = observability.Timings()
    with timings.stage("a"):
        pass
    assert list(timings) == ["a"] and timings["a"] < 100


def test_event_stream_order(spark):
    found = spark.createDataFrame([(1, 0, "c", "L, art. 1", 0.5, ["sparse"], date(2030, 1, 1), True)], "query_id long, index int, chunk_id string, citation string, score double, retrieved_by array<string>, application_date date, not_yet_applicable boolean")
    events = spark.createDataFrame([(1, 0, "delta", "a", None, None), (1, 1, "citation", "a", 0, None), (1, 2, "completed", None, None, "max_tokens"), (2, 0, "completed", None, None, "refusal")], "query_id long, seq int, type string, text string, source_index int, stop_reason string")
    events = events.withColumns({"model": F.lit("m")} | {c: F.lit(1) for c in ("input_tokens", "output_tokens")})
    rows = [(r["query_id"], r["seq"], r["type"]) for r in answering.event_stream(found, events).orderBy("query_id", "seq").collect()]
    assert rows == [(1, 0, "sources"), (1, 1, "warning"), (1, 2, "delta"), (1, 3, "citation"), (1, 4, "warning"), (1, 5, "done"), (2, 0, "sources"), (2, 1, "warning"), (2, 2, "done")]


def test_model_as_reranker(spark, engine):
    queries = spark.createDataFrame([(1, "regla texto")], "query_id long, query string")
    by_length = retrieval.Model(lambda asked, passages: [float(len(p)) for p in passages])
    rows = engine.search(queries, k=4, mode="sparse", use_references=False, scorer=by_length).orderBy("rank").collect()
    assert len(rows) > 1 and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True) and all("rerank" in r["sources"] for r in rows)


def test_command_line(spark, tmp_path, capsys):
    import json

    from lexframe import __version__, cli

    raw = tmp_path / "raw" / "N-1"
    raw.mkdir(parents=True)
    (raw / "texto.xml").write_text(XML, "utf-8")
    (raw / "indice.json").write_text('{"status":{"code":"200"},"data":[]}', "utf-8")
    (tmp_path / "catalog.json").write_text(json.dumps(NORMS[:1]), "utf-8")
    (tmp_path / "q.json").write_text('{"id":"1","category":"literal","question":"artículo 1 de la Ley 7/1999","gold":["LPX art. 1"]}\n', "utf-8")
    base = ["--store", str(tmp_path / "store"), "--catalog", str(tmp_path / "catalog.json"), "--landing", str(tmp_path / "raw")]
    log, report = str(tmp_path / "log"), str(tmp_path / "report")
    for command, shown in (
        (["version"], __version__), (["ingest"], "created"), (["search", "plazos"], "LPX"), (["norms"], "LPX"), (["ready"], "true"), (["ask", "artículo 1 de la Ley 7/1999", "--log", log], "Texto actual."),
        (["ask", "artículo 1 de la Ley 7/1999", "--events"], "event: done"), (["eval", str(tmp_path / "q.json"), "--configs", "sparse+refs", "--report", report], "| sparse+refs | overall | 1.000"),
    ):
        cli.main([*base, *command])
        assert shown in capsys.readouterr().out
    assert spark.read.json(log).first()["query"].startswith("artículo 1") and spark.read.json(report).where("category = 'overall'").first()["recall_at_1"] == 1.0


def test_fetch_and_land(spark, tmp_path, norms):
    """A service on this machine: parts are fetched where some are missing; an error status is not written."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lexframe.sources import landing

    status, asked = ["200"], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            body = (XML if self.path.endswith("texto") else '{"status":{"code":"%s"},"data":[]}' % status[0]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, root = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "raw")
    assert landing.fetch_snapshots(spark, root, norms, base) == 3 and len(asked) == 3
    assert xml.blocks(landing.read_text(spark, root)).count() == 6
    assert landing.fetch_snapshots(spark, root, norms, base) == 0 and len(asked) == 3
    status[0] = "404"
    with pytest.raises(Exception, match="status 404"):
        landing.fetch_snapshots(spark, root, norms, base, refresh=True)
    server.shutdown()
