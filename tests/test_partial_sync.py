"""A sync of some norms leaves the others as they are."""

import json
from datetime import date

import pytest

from lexframe import cli
from lexframe.operators.dense import HashEmbedder
from lexframe.plans.engine import Engine
from lexframe.sources import catalog, xml
from lexframe.streaming import ingest

from .literals import NORMS, XML

INDEX = '{"status":{"code":"200"},"data":{"bloque":[{"id":"plazos","titulo":"x","fecha_actualizacion":"%s"}]}}'


def land(root, norm, day, text):
    folder = root / norm
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "texto.xml").write_text(text, "utf-8")
    (folder / "indice.json").write_text(INDEX % day, "utf-8")


def chunks(engine):
    return {r["norm_id"]: r["count"] for r in engine._chunks().groupBy("norm_id").count().collect()}


def test_second_batch_of_one_norm(spark, tmp_path):
    norms, raw = catalog.norms(spark, NORMS), tmp_path / "raw"
    engine = Engine(spark, str(tmp_path / "store"), norms)
    reports = []

    def sync(blocks, index, day, only):
        reports.append({r["norm_id"]: r["status"] for r in engine.sync(blocks, index, day, only=only).collect()})

    watch = lambda: ingest.watch(spark, str(raw), str(tmp_path / "cp"), sync, lambda: date(2026, 1, 1)).awaitTermination(120)
    land(raw, "N-1", "20210301", XML)
    watch()
    before = chunks(engine)
    land(raw, "N-2", "20210301", XML)
    watch()
    after = chunks(engine)
    assert reports == [{"N-1": "created"}, {"N-2": "created"}]
    assert set(before) == {"N-1"} and set(after) == {"N-1", "N-2"} and after["N-1"] == before["N-1"]
    assert engine.store.read("vectors", "norm_id string").where("norm_id = 'N-1'").count() == before["N-1"]


def test_command_line_of_one_norm(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    (tmp_path / "catalog.json").write_text(json.dumps(NORMS), "utf-8")
    call = ["--store", store, "--catalog", str(tmp_path / "catalog.json"), "--landing", str(raw), "ingest"]
    land(raw, "N-1", "20210301", XML)
    land(raw, "N-2", "20210301", XML)
    cli.main(call)
    engine = Engine(spark, store, catalog.norms(spark, NORMS))
    before = chunks(engine)
    land(raw, "N-1", "20260101", XML)
    cli.main([*call, "--norm", "N-1"])
    assert set(before) == {"N-1", "N-2"} and chunks(engine) == before


def test_a_norm_without_provisions_in_force_fails_by_itself(spark, tmp_path):
    norms = catalog.norms(spark, NORMS)
    engine = Engine(spark, str(tmp_path / "store"), norms)
    blocks = lambda day: xml.blocks(spark.createDataFrame([(n, XML.replace("20000101", d)) for n, d in (("N-1", "20000101"), ("N-2", day))], "norm_id string, payload string"))
    index = lambda day: spark.createDataFrame([("N-1", 0, "a1", "x", date(2020, 1, 1)), ("N-2", 0, "a1", "x", day)], "norm_id string, ord int, block_id string, title string, updated_at date")
    engine.sync(blocks("20000101"), index(date(2020, 1, 1)), date(2026, 1, 1))
    before = chunks(engine)
    none = xml.blocks(spark.createDataFrame([("N-1", XML), ("N-2", "<response><status><code>200</code></status><data><texto><bloque id='z' tipo='nota' titulo='z'></bloque></texto></data></response>")], "norm_id string, payload string"))
    report = {r["norm_id"]: (r["status"], r["reason"]) for r in engine.sync(none, index(date(2026, 1, 1)), date(2026, 1, 1)).collect()}
    assert report["N-2"] == ("failed", "no provisions in force") and report["N-1"][0] == "skipped"
    assert chunks(engine) == before


def test_vectors_of_another_dimension_are_refused(spark, tmp_path):
    norms = catalog.norms(spark, NORMS)
    engine = Engine(spark, str(tmp_path / "store"), norms)
    index = lambda day: spark.createDataFrame([("N-1", 0, "a1", "x", day)], "norm_id string, ord int, block_id string, title string, updated_at date")
    engine.sync(xml.blocks(spark.createDataFrame([("N-1", XML)], "norm_id string, payload string")), index(date(2020, 1, 1)), date(2026, 1, 1))
    before, narrow = chunks(engine), HashEmbedder(4)
    narrow.name = engine.embedder.name
    engine.embedder = narrow
    with pytest.raises(Exception, match="expected 8 dimensions"):
        engine.sync(xml.blocks(spark.createDataFrame([("N-1", XML.replace("Diez", "Doce"))], "norm_id string, payload string")), index(date(2026, 1, 1)), date(2026, 1, 1))
    assert chunks(engine) == before
