"""Sources and sinks of snapshots against a service on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lexframe.sources import catalog, landing
from lexframe.streaming import ingest

from .literals import NORMS, XML

DAYS = {"N-1": "20210301", "N-2": "20210301"}


@pytest.fixture()
def service():
    asked, days, status = [], dict(DAYS), ["200"]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            norm = self.path.split("/")[2]
            if self.path.endswith("indice"):
                body = {"status": {"code": status[0]}, "data": [{"bloque": [{"id": "a1", "fecha_actualizacion": days[norm]}]}]}
            else:
                body = {"status": {"code": status[0]}, "data": []}
            self.send_response(200)
            self.end_headers()
            self.wfile.write((XML if self.path.endswith("texto") else json.dumps(body)).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, days, status
    server.shutdown()


@pytest.fixture(scope="module")
def norms(spark):
    return catalog.norms(spark, NORMS)


def taken(asked):
    found = sorted(asked)
    asked.clear()
    return found


def test_only_changed_norms_are_fetched(spark, tmp_path, norms, service):
    base, asked, days, status = service
    root = str(tmp_path / "raw")
    fetch = lambda: landing.fetch_changed(spark, root, norms, base, pause="0")
    assert fetch() == 6 and len(taken(asked)) == 6
    assert fetch() == 0 and taken(asked) == ["/id/N-1/texto/indice", "/id/N-2/texto/indice"]
    days["N-2"] = "20250101"
    assert fetch() == 3 and taken(asked) == ["/id/N-1/texto/indice", "/id/N-2/metadatos", "/id/N-2/texto", "/id/N-2/texto/indice"]
    assert {r["norm_id"]: str(r["updated_at"]) for r in landing.parse_index(landing.read_json(spark, root, landing.INDEX)).collect()} == {"N-1": "2021-03-01", "N-2": "2025-01-01"}
    (tmp_path / "raw" / "N-1" / landing.METADATA).unlink()
    assert fetch() == 3 and [p for p in taken(asked) if "N-2" in p] == ["/id/N-2/texto/indice"]
    days["N-1"], status[0] = "20250101", "404"
    with pytest.raises(Exception, match="status 404"):
        fetch()
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["N-1", "N-2"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(8, numPartitions=4).select(F.concat(F.lit("N-"), "id").alias("norm_id"), F.lit(landing.TEXT).alias("name"), F.when(F.col("id") == 6, F.raise_error(F.lit("lost"))).otherwise(F.lit("ñ")).alias("payload"))
    with pytest.raises(Exception, match="lost"):
        landing.land(rows, str(tmp_path / "raw"))
    assert not (tmp_path / "raw").exists() or not list((tmp_path / "raw").iterdir())
    assert landing.land(rows.where("id <> 6"), str(tmp_path / "raw")) == 7
    assert (tmp_path / "raw" / "N-3" / landing.TEXT).read_text("utf-8") == "ñ" and len(list((tmp_path / "raw").iterdir())) == 7
    with pytest.raises(Exception, match="not a file of a norm"):
        landing.land(spark.createDataFrame([("../x", landing.TEXT, "")], "norm_id string, name string, payload string"), str(tmp_path / "raw"))
    assert len(list((tmp_path / "raw").iterdir())) == 7


def test_empty_rows_land_nothing(spark, tmp_path):
    assert landing.land(spark.createDataFrame([], "norm_id string, name string, payload string"), str(tmp_path / "raw")) == 0


def test_poll_asks_for_changed_norms_only(spark, tmp_path, norms, service):
    base, asked, days, _ = service
    root = str(tmp_path / "raw")

    def poll():
        ingest.poll(spark, root, str(tmp_path / "seen"), norms, base, pause="0").awaitTermination()
        return {p for p in taken(asked) if not p.endswith("indice")}

    assert poll() == {f"/id/{n}/{p}" for n in DAYS for p in ("metadatos", "texto")}
    assert poll() == set()
    days["N-1"] = "20260101"
    assert poll() == {"/id/N-1/metadatos", "/id/N-1/texto"}
    assert landing.missing(spark, root, norms).isEmpty()
