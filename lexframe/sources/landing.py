"""Raw snapshots: a folder per norm with its text, index and metadata, read by Spark; and the parsers of the JSON parts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_date
from ..operators import incremental
from . import remote

TEXT, INDEX, METADATA = "texto.xml", "indice.json", "metadatos.json"
# The service's paths of the three parts.
PARTS = {METADATA: "id/{id}/metadatos", INDEX: "id/{id}/texto/indice", TEXT: "id/{id}/texto"}


def _whole(spark: SparkSession, root: str, name: str) -> DataFrame:
    files = spark.read.text(f"{root}/*/{name}", wholetext=True).withColumnRenamed("value", "payload")
    return files.withColumn("norm_id", F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_text(spark: SparkSession, root: str) -> DataFrame:
    """(norm_id, payload) of all consolidated texts under ``root``."""
    return _whole(spark, root, TEXT)


def read_json(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _whole(spark, root, name)


def read_of(spark: SparkSession, root: str, name: str, norms: list[str]) -> DataFrame:
    """(norm_id, payload) of the files ``name`` that are there of ``norms``; no other folder is opened."""
    files, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    paths = [files.Path(f"{root.rstrip('/')}/{n}/{name}") for n in norms]
    there = [p.toString() for p in paths if p.getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], "norm_id string, payload string")
    found = spark.read.text(there, wholetext=True).withColumnRenamed("value", "payload")
    return found.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("norm_id"), "payload")


def missing(spark: SparkSession, root: str, catalog: DataFrame) -> DataFrame:
    """Norms of the catalog that lack one of the three files: these have to be fetched."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return catalog.select("norm_id")
    found = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.split("path", "/").alias("p"))
    whole = found.select(F.element_at("p", -2).alias("norm_id"), F.element_at("p", -1).alias("f")).where(F.col("f").isin(TEXT, INDEX, METADATA))
    whole = whole.groupBy("norm_id").agg(F.count_distinct("f").alias("n")).where("n = 3")
    return catalog.join(whole, "norm_id", "left_anti").select("norm_id")


def land(rows: DataFrame, root: str) -> int:
    """Writes (norm_id, name, payload) as files of the norms' folders and returns how many. Executors write, and a job that fails
    leaves nothing; JSON payloads with an error status are failures."""
    remote.register(rows.sparkSession)
    payload = F.when(F.col("name") == TEXT, F.col("payload")).otherwise(accepted(F.col("payload")))
    counted = Observation()
    rows = rows.select("norm_id", "name", payload.alias("payload")).observe(counted, F.count(F.lit(1)).alias("files"))
    staging = f"_landing-{uuid.uuid4().hex}"
    try:
        rows.write.format("norm_snapshots").mode("append").option("last", INDEX).option("staging", staging).save(root)
    finally:  # a job that fails before its last stage is not told to the writer
        _delete(rows.sparkSession, f"{root.rstrip('/')}/{staging}")
    return counted.get["files"]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _service(spark: SparkSession, base: str, ids: list[str], names: tuple[str, ...], **options: str) -> dict[str, str]:
    remote.register(spark)
    parts = {n: [PARTS[n], "application/xml" if n == TEXT else "application/json"] for n in names}
    return {"base": base, "ids": ",".join(ids), "parts": json.dumps(parts), "index": INDEX, **options}


def _ids(norms: DataFrame) -> list[str]:
    return [r[0] for r in norms.select("norm_id").orderBy("norm_id").collect()]  # a catalog is a small dimension


def fetch_snapshots(spark: SparkSession, root: str, catalog: DataFrame, base: str, refresh: bool = False, **options: str) -> int:
    """Fetches the three parts of the norms that lack one, or of all with ``refresh``, into ``root``; returns the number of files.

    ``base`` is the address of the service. Nothing is written unless all payloads came and none has an error status.
    """
    ids = _ids(catalog if refresh else missing(spark, root, catalog))
    return land(spark.read.format("norm_service").options(**_service(spark, base, ids, tuple(PARTS), **options)).load(), root) if ids else 0


def fetch_changed(spark: SparkSession, root: str, catalog: DataFrame, base: str, **options: str) -> int:
    """Fetches the index of every norm, and text and metadata of those only whose index is not the one in ``root``, or that lack a
    file there; returns the number of files written. Other norms cost one request and are not written."""
    ids = _ids(catalog)
    if not ids:
        return 0
    lacking = missing(spark, root, catalog)
    whole = catalog.select("norm_id").join(lacking, "norm_id", "left_anti")
    pending = f"{root.rstrip('/')}/_pending-{uuid.uuid4().hex}"  # asked for once, used twice
    try:
        spark.read.format("norm_service").options(**_service(spark, base, ids, (INDEX,), **options)).load().write.parquet(pending)
        indices = spark.read.parquet(pending)
        wanted = lacking
        if not whole.isEmpty():
            prints = lambda raw, name: incremental.fingerprints(parse_index(raw)).withColumnRenamed("fingerprint", name)
            held = prints(read_json(spark, root, INDEX).join(whole, "norm_id", "left_semi"), "held")
            both = whole.join(held, "norm_id", "left").join(prints(indices, "found"), "norm_id", "left")
            wanted = wanted.unionByName(both.where(~F.col("held").eqNullSafe(F.col("found"))).select("norm_id"))
        due = _ids(wanted)
        if not due:
            return 0
        rest = spark.read.format("norm_service").options(**_service(spark, base, due, (METADATA, TEXT), **options)).load()
        return land(rest.unionByName(indices.where(F.col("norm_id").isin(due))), root)
    finally:
        _delete(spark, pending)


def changes(spark: SparkSession, catalog: DataFrame, base: str, **options: str) -> DataFrame:
    """Stream of (norm_id, name, payload): the three parts of every norm, then of those whose index changes."""
    return spark.readStream.format("norm_service").options(**_service(spark, base, _ids(catalog), tuple(PARTS), **options)).load()


def accepted(payload: Column) -> Column:
    """``payload``; an error unless its status code is 200."""
    code = F.get_json_object(payload, "$.status.code")
    return F.when(code == "200", payload).otherwise(F.raise_error(F.concat(F.lit("response has status "), F.coalesce(code, F.lit("none")))))


def checked(payload: Column) -> Column:
    """The ``data`` member of an accepted payload as JSON text."""
    return F.get_json_object(accepted(payload), "$.data")


def parse_index(raw: DataFrame) -> DataFrame:
    """(norm_id, ord, block_id, title, updated_at) of index payloads; ``data`` is a list or one object, titles may be missing."""
    entry = "array<struct<bloque:array<struct<id:string,titulo:string,fecha_actualizacion:string>>>>"
    data = checked(F.col("payload"))
    data = F.when(data.startswith("["), data).otherwise(F.concat(F.lit("["), data, F.lit("]")))
    rows = raw.select("norm_id", F.posexplode(F.flatten(F.transform(F.from_json(data, entry), lambda d: d["bloque"]))).alias("ord", "b"))
    return rows.select("norm_id", "ord", F.col("b.id").alias("block_id"), F.coalesce("b.titulo", F.lit("")).alias("title"), parse_date(F.col("b.fecha_actualizacion")).alias("updated_at"))


def parse_metadata(raw: DataFrame) -> DataFrame:
    """One row per norm; fields are scalars or objects with a ``texto`` member."""
    data = checked(F.col("payload"))
    first = F.when(data.startswith("["), F.get_json_object(data, "$[0]")).otherwise(data)

    def field(name: str) -> Column:
        return F.coalesce(F.get_json_object(first, f"$.{name}.texto"), F.get_json_object(first, f"$.{name}"))

    day = field("fecha_vigencia")
    return raw.select(
        "norm_id", field("titulo").alias("title"), field("rango").alias("rank"), F.when(day != "", parse_date(day)).alias("entry_into_force"),
        F.when(field("url_eli") != "", field("url_eli")).alias("eli_url"),
        F.coalesce(F.when(field("url_html_consolidada") != "", field("url_html_consolidada")), F.concat(F.lit("https://www.boe.es/buscar/act.php?id="), F.col("norm_id"))).alias("consolidated_html_url"),
        (F.coalesce(field("estatus_derogacion"), F.lit("")) == "S").alias("repealed"),
    )
