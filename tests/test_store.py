"""The store updates parts, keeps old versions readable, and prunes what a search reads."""

from collections import Counter
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexframe.operators import lexical, store
from lexframe.operators.store import Buckets, Segment, Store
from lexframe.plans.engine import Engine
from lexframe.sources import catalog, xml

from .literals import NORMS, XML


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def keyed(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_buckets_are_written_one_by_one(spark, tmp_path):
    held = Store(spark, str(tmp_path), buckets=16)
    held.commit(t=Buckets(keyed(spark, *[(f"k{i}", i) for i in range(200)]), "k"))
    before = files(tmp_path)
    touched = held.touched(spark.createDataFrame([("k7",)], "k string"))
    own = held.read("t", "k string, v int", touched)
    assert len(touched) == 1 and own.count() < 40
    held.commit(t=Buckets(own.where("k <> 'k7'").unionByName(keyed(spark, ("k7", -7))), "k", touched))
    after = files(tmp_path)
    assert len(set(after) - set(before)) == 1 and all(after[p] == m for p, m in before.items())
    assert rows(held.read("t", "k string, v int")) == sorted([(f"k{i}", i) for i in range(200) if i != 7] + [("k7", -7)])
    assert ("k7", 7) in rows(held.read("t", "k string, v int", version=1))


def test_a_bucket_that_empties_goes(spark, tmp_path):
    held = Store(spark, str(tmp_path), buckets=4)
    held.commit(t=Buckets(keyed(spark, ("a", 1), ("b", 2), ("c", 3)), "k"))
    everything = list(range(4))
    held.commit(t=Buckets(held.read("t", "k string, v int", everything).limit(0), "k", everything))
    assert held.read("t", "k string, v int").count() == 0 and held.read("t", "k string, v int", version=1).count() == 3


def test_segments_leave_dead_rows_out(spark, tmp_path):
    held = Store(spark, str(tmp_path), buckets=4)
    made = lambda n, *terms: spark.createDataFrame([(n, t) for t in terms], "norm string, term string")
    schema, owner = "norm string, term string", lambda *n: spark.createDataFrame([(x,) for x in n], "norm string")
    held.commit(p=Segment(made("n1", "a", "b").union(made("n2", "a")), "term"))
    held.commit(p=Segment(made("n1", "c"), "term", owner("n1")))
    assert rows(held.read("p", schema)) == [("n1", "c"), ("n2", "a")]
    held.commit(p=Segment(made("n3", "a"), "term", owner("n2", "n9")))
    assert rows(held.read("p", schema)) == [("n1", "c"), ("n3", "a")]
    assert rows(held.read("p", schema, version=1)) == [("n1", "a"), ("n1", "b"), ("n2", "a")]
    for k in range(store.MOST_SEGMENTS):  # more segments than are kept apart
        held.commit(p=Segment(made("n1", f"t{k}"), "term", owner("n1")))
    assert rows(held.read("p", schema)) == [("n1", f"t{store.MOST_SEGMENTS - 1}"), ("n3", "a")]
    assert len(held._manifest()["tables"]["p"]["segments"]) <= store.MOST_SEGMENTS
    held.commit(p=Segment(made("n5", "z"), "term", fresh=True))
    assert rows(held.read("p", schema)) == [("n5", "z")]


def test_vacuum_keeps_what_kept_versions_read(spark, tmp_path):
    held = Store(spark, str(tmp_path), buckets=8)
    schema = "k string, v int"
    held.commit(t=Buckets(keyed(spark, *[(f"k{i}", 0) for i in range(50)]), "k"), w=keyed(spark, ("x", 1)))
    for n in range(1, 4):
        touched = held.touched(keyed(spark, ("k3", n)))
        held.commit(t=Buckets(held.read("t", schema, touched).where("k <> 'k3'").unionByName(keyed(spark, ("k3", n))), "k", touched), w=keyed(spark, ("x", n)))
    reader, old = held.read("t", schema, version=3), rows(held.read("t", schema, version=3))
    gone = held.vacuum(keep=2)
    assert held.versions() == [3, 4] and gone and not any(Path(p).exists() for p in gone)
    assert rows(reader) == old and dict(rows(held.read("t", schema)))["k3"] == 3 and rows(held.read("w", schema)) == [("x", 3)]
    assert len(rows(held.read("t", schema))) == 50 and held.vacuum(keep=2) == []
    with pytest.raises(LookupError, match="version 1"):
        held.read("t", schema, version=1)


def test_search_opens_the_parts_of_its_terms(spark, tmp_path):
    texts = spark.createDataFrame([(i, " ".join(f"{a}{b}" for a in "abc" for b in ["lfa", "eta", "ama"][: i % 4])) for i in range(40)], "doc_id long, text string")
    held = Store(spark, str(tmp_path), buckets=16)
    schema = "doc_id long, n_terms int, term string, tf long"
    held.commit(postings=Segment(lexical.postings(texts, "doc_id", "text").select("doc_id", "n_terms", "term", "tf"), "term"))
    queries = spark.createDataFrame([(1, "alfa beta"), (2, "cama zzz"), (3, "")], "query_id long, query string")
    asked = lexical.asked_terms(queries, "query_id", "query", False)
    kept, parts = held.parts("postings", schema)
    plan = lexical.pruned(kept, asked, parts)._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0] and " IN " in plan.split("PartitionFilters: [")[1].split("]")[0].upper()
    assert len(lexical.pruned(kept, asked, parts).inputFiles()) < len(kept.inputFiles()) or "PartitionFilters" in plan
    found = lexical.search_postings(kept, asked, 5, "doc_id", "query_id", parts=parts)
    expected = lexical.search(texts, queries, 5)
    assert rows(found.select("query_id", "doc_id", "score", "rank")) == rows(expected.select("query_id", "doc_id", "score", "rank"))


def test_a_sync_of_one_norm_among_twenty_writes_its_buckets_only(spark, tmp_path):
    names = [f"N-{i}" for i in range(20)]
    norms = catalog.norms(spark, [{**NORMS[0], "norm_id": n, "short_name": n, "aliases": [n]} for n in names])
    engine = Engine(spark, str(tmp_path), norms)
    blocks = lambda changed: xml.blocks(spark.createDataFrame([(n, XML.replace("Diez", "Doce") if n == changed else XML) for n in names], "norm_id string, payload string"))
    index = lambda changed: spark.createDataFrame([(n, 0, "a1", "x", date(2026, 2, 1) if n == changed else date(2026, 1, 1)) for n in names], "norm_id string, ord int, block_id string, title string, updated_at date")
    engine.sync(blocks(None), index(None), date(2026, 3, 1))
    before, old = files(tmp_path), Counter(r["norm_id"] for r in engine._chunks().collect())
    first = engine.store.versions()[-1]
    report = {r["norm_id"]: r["status"] for r in engine.sync(blocks("N-5"), index("N-5"), date(2026, 3, 1)).collect()}
    assert {n for n, s in report.items() if s != "skipped"} == {"N-5"}
    new = [p for p in files(tmp_path) if p not in before]
    for table in ("chunks", "vectors", "hashes"):
        assert len([p for p in new if f"/{table}/" in p]) == 1, table
    assert Counter(r["norm_id"] for r in engine._chunks().collect()) == old
    assert engine.store.read("chunks", "norm_id string, text string", version=first).where("text LIKE '%Doce%'").count() == 0
    assert engine._chunks().where(F.col("text").contains("Doce")).select("norm_id").distinct().count() == 1
    queries = spark.createDataFrame([(1, "plazo de doce meses")], "query_id long, query string")
    assert engine.search(queries, 3, "sparse", use_references=False).where("rank = 1").first()["norm_id"] == "N-5"
    engine.store.vacuum(1)
    assert engine.search(queries, 3, "sparse", use_references=False).count() == 3
