from datetime import date
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lexframe.operators import chunking, structure
from lexframe.sources import catalog, landing, remote, xml

from .literals import APPROVED, HEADINGS, MARKED, NORMS, OVER_TIME, TABLES, XML


@pytest.fixture(scope="module")
def norms(spark):
    return catalog.norms(spark, NORMS)


def blocks_of(spark, text):
    return xml.blocks(spark.createDataFrame([("N-1", text)], "norm_id string, payload string"))


def provisions(spark, norms, text, day):
    index = spark.createDataFrame([("N-1", "a8", date(2022, 5, 5))], "norm_id string, block_id string, updated_at date")
    return structure.build_provisions(blocks_of(spark, text), norms, index, day).orderBy("ord")


def test_catalog(spark, norms):
    assert catalog.get(norms, "N-2")["short_name"] == "RDX"
    with pytest.raises(KeyError):
        catalog.get(norms, "none")
    names = [r["alias"] for r in catalog.aliases(norms).orderBy(F.desc("length"), "ord").collect()]
    assert names[0] == "real decreto 8/2001" and set(names[-3:]) == {"lpx", "rdx", "ley"}


@pytest.mark.parametrize("day, since", [(date(2005, 1, 1), date(2000, 1, 2)), (date(2026, 1, 1), date(2021, 3, 1)), (date(2029, 12, 31), date(2029, 12, 31)), (date(1999, 1, 1), None)])
def test_wording_as_of(spark, day, since):
    row = blocks_of(spark, OVER_TIME).select(structure.version_in_force(F.col("versions"), F.col("expired_on"), F.lit(day)).alias("v")).first()
    assert (row["v"]["in_force_since"] if row["v"] else None) == since


def test_headings(spark, norms):
    rows = {r["block_id"]: r for r in provisions(spark, norms, HEADINGS, date(2026, 1, 1)).collect()}
    assert list(rows) == ["a7", "a8", "dt"]
    assert rows["a7"]["hierarchy"] == ["LIBRO II. De los ensayos"] and rows["a7"]["heading"] == "Materia 7"
    assert rows["a8"]["hierarchy"] == ["LIBRO II. De los ensayos", "CAPÍTULO V. Muestras", "Sección 2.ª Envases"] and rows["a8"]["number"] == "8 ter" and rows["a8"]["block_updated_at"] == date(2022, 5, 5)
    assert rows["dt"]["hierarchy"] == [] and (rows["dt"]["kind"], rows["dt"]["number"], rows["dt"]["heading"]) == ("disposicion_transitoria", "11", "Ritmo")


def test_marked_provisions(spark, norms):
    rows = {r["block_id"]: r["repealed"] for r in provisions(spark, norms, MARKED, date(2026, 1, 1)).collect()}
    assert rows == {"a6": True}
    assert [r["block_id"] for r in provisions(spark, norms, MARKED, date(2009, 1, 1)).collect()] == ["a5", "a6"]
    assert [r["block_id"] for r in provisions(spark, norms, APPROVED, date(2026, 1, 1)).collect()] == ["a2"]


def test_notes(spark, norms):
    row = provisions(spark, norms, OVER_TIME, date(2026, 1, 1)).first()
    assert row["amendment_notes"] == ["Redacción de 2021."] and [p["kind"] for p in row["paragraphs"]] == ["text", "note"]


def test_tables(spark, norms):
    annex = provisions(spark, norms, TABLES, date(2026, 1, 1)).first()
    assert annex["kind"] == "anexo" and annex["number"] is None and annex["heading"] == "Medidas"
    tables = [p for p in annex["paragraphs"] if p["kind"] == "table"]
    assert [p["css_class"] for p in tables] == ["table", "numeric_table", "numeric_table"]
    assert tables[0]["text"].split("\n") == ["| Clase | Uso |", "| --- | --- |", "| vidrio/barro | agua |"]
    assert "Títulos: Tabla 3.C. Columnas: col0 | col1 | col2. 9 filas." in tables[1]["text"] and "Tabla 3.D" in tables[2]["text"] and "12 filas" in tables[2]["text"]


def test_refuses_entities_and_bad_status(spark):
    for bad in ("<!DOCTYPE x><response/>", "<response><status><code>404</code></status></response>"):
        with pytest.raises(ValueError):
            list(xml.parse_blocks("N", bad))


def test_scope(spark, norms):
    def scoped(extra, until="a3"):
        scope = F.struct(F.lit("cap").alias("from_block"), F.lit(until).alias("until_block"), F.array(*map(F.lit, extra)).alias("extra_blocks"))
        return structure.in_scope(structure.after_approval(blocks_of(spark, XML)), norms.where("ord = 0").withColumn("scope", scope))

    assert [r["block_id"] for r in scoped(["plazos"]).orderBy("ord").collect()] == ["plazos", "cap", "a1", "a2"]
    with pytest.raises(Exception, match="scope block not found"):
        scoped(["zz"]).collect()


def test_next_change(spark, norms):
    changes = lambda text, d: structure.next_scheduled_change(blocks_of(spark, text), norms.where("ord = 0"), d).first()["next_change"]
    assert changes(OVER_TIME, date(2026, 1, 1)) == date(2029, 12, 31) and changes(MARKED, date(2005, 1, 1)) == date(2010, 1, 1) and changes(XML, date(2031, 1, 1)) is None


def test_chunks(spark, norms):
    found = provisions(spark, norms, XML, date(2026, 1, 1)).cache()
    rows = chunking.chunk_provisions(found, norms).collect()
    by_block = {r["block_id"]: r for r in rows}
    assert len(by_block) == len(rows) == 5
    assert by_block["a1"]["text"] == "Texto actual.\n[Nota de la edición consolidada: Véase el anejo.]"
    assert by_block["a1"]["embed_text"].split("\n")[:3] == ["LPX — Ley de Pruebas", "CAPÍTULO IV. De las pruebas", "Artículo 1. Materia 1"]
    empty = chunking.chunk_provisions(provisions(spark, norms, MARKED, date(2026, 1, 1)), norms).first()
    assert empty["text"] == "(Sin contenido)" and empty["repealed"]
    statistics = structure.norm_statistics(norms.where("ord = 0"), found, chunking.chunk_provisions(found, norms)).first()
    assert statistics["articulo"] == 4 and statistics["disposicion_adicional"] == 1 and statistics["provisions"] == 5 and statistics["repealed"] == 0


PARAGRAPHS = "array<struct<kind:string,text:string,css_class:string>>"


def pieces(spark, paragraphs, limit):
    df = spark.createDataFrame([([(k, t, None) for k, t in paragraphs],)], f"p {PARAGRAPHS}")
    return [(r["x"]["apartado"], [i["text"] for i in r["x"]["items"]]) for r in df.select(F.explode(chunking.split(F.col("p"), limit)).alias("x")).collect()]


def test_apartados_follow_the_sequence(spark):
    paragraphs = [("text", "Entrada."), ("text", "1. Uno " + "x" * 30), ("text", "1.º dentro"), ("text", "2. Dos " + "y" * 30), ("text", "4. salto")]
    assert [(a, len(t)) for a, t in pieces(spark, paragraphs, 80)] == [("1", 3), ("2", 2)]


def test_short_stays_whole(spark):
    assert pieces(spark, [("text", "1. a"), ("text", "2. b")], 400) == [(None, ["1. a", "2. b"])]
    assert pieces(spark, [], 400) == [(None, [])]


def test_windows_keep_headings_with_what_follows(spark):
    paragraphs = [("heading", "A"), ("text", "a" * 50), ("heading", "B"), ("text", "b" * 90), ("text", "c" * 30)]
    found = pieces(spark, paragraphs, 100)
    assert [t[0][:1] for _, t in found] == ["A", "B", "c"] and [x for _, t in found for x in t] == [t for _, t in paragraphs]


def test_sentences_and_tables_split(spark):
    long = "Uno dos. " * 30
    found = pieces(spark, [("text", long.strip())], 60)
    assert all(len(t[0]) <= 60 for _, t in found) and " ".join(t[0] for _, t in found) == long.strip()
    table = "\n".join(["Título", "| a | b |", "| --- | --- |", *[f"| {i} | valor |" for i in range(20)]])
    found = pieces(spark, [("table", table)], 90)
    assert len(found) > 1 and all(t[0].startswith("Título\n| a | b |\n| --- | --- |\n") and len(t[0]) <= 90 for _, t in found)
    assert [line for _, t in found for line in t[0].split("\n")[3:]] == table.split("\n")[3:]


def test_landing(spark, tmp_path, norms):
    folder = tmp_path / "N-1"
    folder.mkdir()
    (folder / landing.TEXT).write_text(XML, "utf-8")
    (folder / landing.INDEX).write_text('{"status":{"code":"200"},"data":[{"bloque":[{"id":"a1","titulo":"Artículo 1","fecha_actualizacion":"20210301"},{"id":"a2","fecha_actualizacion":"20000101"}]}]}', "utf-8")
    (folder / landing.METADATA).write_text('{"status":{"code":"200"},"data":[{"titulo":"Ley","rango":{"codigo":"1","texto":"Ley"},"fecha_vigencia":"20000102","estatus_derogacion":"S"}]}', "utf-8")
    assert xml.blocks(landing.read_text(spark, str(tmp_path))).count() == 6
    index = landing.parse_index(landing.read_json(spark, str(tmp_path), landing.INDEX)).orderBy("ord").collect()
    assert [(r["block_id"], r["title"], r["updated_at"]) for r in index] == [("a1", "Artículo 1", date(2021, 3, 1)), ("a2", "", date(2000, 1, 1))]
    meta = landing.parse_metadata(landing.read_json(spark, str(tmp_path), landing.METADATA)).first()
    assert meta["rank"] == "Ley" and meta["repealed"] and meta["entry_into_force"] == date(2000, 1, 2) and meta["consolidated_html_url"].endswith("id=N-1")
    assert [r[0] for r in landing.missing(spark, str(tmp_path), norms).collect()] == ["N-2"]
    bad = spark.createDataFrame([('{"status":{"code":"404"}}',)], "p string").select(landing.checked(F.col("p")))
    with pytest.raises(Exception, match="status 404"):
        bad.collect()


def test_fetch_retries_with_backoff():
    import io
    import urllib.error

    calls, waits = [], []

    class Body(io.BytesIO):
        def __enter__(self):
            return self

    def opened(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", None, None)
        return Body(b"ok")

    assert remote.fetch("http://x/y", "a/b", pause=waits.append, opened=opened) == "ok" and waits == [1.0, 2.0]

    def fatal(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 404, "none", None, None)

    with pytest.raises(urllib.error.HTTPError):
        remote.fetch("http://x/y", "a/b", pause=waits.append, opened=fatal)
    assert len(waits) == 2


def test_apartados_of_long_provisions_take_time_in_proportion(spark):
    import time

    def seconds(n):
        items = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.lit("text").alias("kind"), F.concat(F.when(i <= 999, i).otherwise(7).cast("string"), F.lit(". Texto del apartado")).alias("text"), F.lit("p").alias("css_class"))).alias("p"))
        items.select(F.size(chunking.apartados(F.col("p")))).first()
        began = time.perf_counter()
        (row,) = items.select(chunking.apartados(F.col("p")).alias("g")).collect()
        assert [g["apartado"] for g in row["g"]] == [str(i) for i in range(1, min(n, 999) + 1)] and sum(len(g["items"]) for g in row["g"]) == n
        return time.perf_counter() - began

    seconds(100)
    assert min(seconds(3200), seconds(3200)) < 2.3 * max(min(seconds(1600), seconds(1600)), 0.5)


def test_blocks_by_a_table_function(spark):
    texts = spark.createDataFrame([("N-1", XML), ("N-2", MARKED), ("N-3", None)], "norm_id string, payload string")
    texts.createOrReplaceTempView("texts_of_norms")
    xml.register(spark)
    found = spark.sql("SELECT b.* FROM texts_of_norms t, LATERAL norm_blocks(t.norm_id, t.payload) b")
    assert found.orderBy("norm_id", "ord").collect() == xml.blocks(texts).orderBy("norm_id", "ord").collect()
    with pytest.raises(Exception, match="status 404"):
        spark.sql("SELECT b.* FROM VALUES ('N', '<response><status><code>404</code></status></response>') t(n, p), LATERAL norm_blocks(n, p) b").collect()


def test_one_block_at_a_time_is_held():
    import tracemalloc

    def peak(n):
        block = '<bloque id="a" tipo="precepto" titulo="Artículo"><version fecha_vigencia="20200101">' + "<p>Texto de un apartado.</p>" * 200 + "</version></bloque>"
        payload = "<response><data>" + block * n + "</data></response>"
        tracemalloc.start()
        assert sum(1 for _ in xml.parse_blocks("N", payload)) == n
        try:
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(800) < 1.5 * peak(40)


def test_a_broken_text_is_an_error():
    with pytest.raises(ElementTree.ParseError):
        list(xml.parse_blocks("N", "<response><data>"))
    with pytest.raises(ElementTree.ParseError):
        list(xml.parse_blocks("N", ""))


def test_blocks_of_many_texts_share_a_batch():
    """A batch holds blocks of several texts, and is closed by its number of blocks or their characters."""
    text = lambda n, k: "<response><data><texto>" + f'<bloque id="b"><version fecha_vigencia="20200101"><p class="parrafo">{"x" * k}</p></version></bloque>' * n + "</texto></data></response>"
    many = list(xml._batches((str(i), text(2, 5)) for i in range(xml.BATCH_BLOCKS)))
    assert [b.num_rows for b in many] == [xml.BATCH_BLOCKS] * 2
    assert many[1].to_pylist()[-1]["norm_id"] == str(xml.BATCH_BLOCKS - 1) and many[1].to_pylist()[-1]["ord"] == 1
    assert [b.num_rows for b in xml._batches(iter([("a", text(3, xml.BATCH_CHARS)), ("b", None), ("c", text(1, 1))]))] == [1, 1, 1, 1]
