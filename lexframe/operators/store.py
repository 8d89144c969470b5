"""A versioned store of Parquet tables, updated by parts.

A version is a manifest: for every table the folders that make it up. Folders are never changed once written, so whoever reads a
version goes on reading it while the next one is made; ``vacuum`` removes what no kept version refers to. There are three kinds of
table.

* Whole tables are written again by each commit that names them.
* ``Buckets`` are dealt out by the hash of a key, such as the norm. A commit writes the buckets that it touches and takes the others
  over from the version before.
* ``Segments`` are added to: a commit writes the new rows, dealt out by the hash of a key, such as the term, and the owners whose
  rows in older segments are dead. Readers leave dead rows out; a table of many segments is written together to one. So a change
  of a few norms adds a few rows although their terms lie everywhere, and a search that names its terms opens their parts only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MOST_SEGMENTS = 8
PART, SEGMENT = "part", "segment"


@dataclass(frozen=True)
class Buckets:
    """The rows of the buckets ``touched``, or of all of them."""

    rows: DataFrame
    key: str
    touched: list[int] | None = None


@dataclass(frozen=True)
class Segment:
    """New rows, parted by ``key``; ``dead`` names the owners (``owner`` columns) whose older rows are no longer to be read."""

    rows: DataFrame
    key: str
    dead: DataFrame | None = None
    fresh: bool = False


def bucket(key: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Store:
    """Tables under ``root``, a folder that all executors see. Only Spark reads and writes rows; manifests are small files of their own."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._session = uuid.uuid4().hex

    # Files ------------------------------------------------------------------------------------------------------------------

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path if path.startswith(self.root) else f"{self.root}/{path}")
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        found, fs = self._path(path)
        fs.delete(found, True)

    def _list(self, path: str) -> list[str]:
        found, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []

    def versions(self) -> list[int]:
        """The versions that can be read, the latest last."""
        return sorted(int(n[1:-5]) for n in self._list("_versions") if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}}
        if version is not None and version not in known:
            raise LookupError(f"version {version} of {self.root} is not kept")
        path, fs = self._path(f"_versions/v{known[-1] if version is None else version}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, tables: dict) -> int:
        """Makes ``tables`` the version: its manifest appears under its name at once or not at all."""
        part, fs = self._path(f"_versions/.v{version}-{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(json.dumps({"version": version, "tables": tables}).encode())
        out.close()
        if not fs.rename(part, self._path(f"_versions/v{version}.json")[0]):
            raise RuntimeError(f"version {version} of {self.root} could not be published")
        return version

    def _claim(self, version: int) -> None:
        """Marks ``version`` as being written; an error if another writer has done so, as one of the two would be lost."""
        path, fs = self._path(f"_claims/v{version}")
        if fs.exists(path) or not fs.createNewFile(path):
            raise RuntimeError(f"version {version} of {self.root} is being written, or its writer failed: see release()")

    def release(self) -> None:
        """Gives up the claim of a writer that failed."""
        self._delete(f"_claims/v{(self.versions() or [0])[-1] + 1}")

    # Scratch ----------------------------------------------------------------------------------------------------------------

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written once beside the tables and read back: what follows has a short plan, and a lost executor loses nothing."""
        path = f"{self.root}/_staging/{self._session}/{label}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written once under ``_answers`` and read back, for results that are read lazily; the folder may be removed when
        they have been."""
        path = f"{self.root}/_answers/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def unstage(self) -> None:
        """Removes what this store has staged."""
        self._delete(f"_staging/{self._session}")

    # Reading ----------------------------------------------------------------------------------------------------------------

    def read(self, table: str, schema: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of ``table``, or of some of its buckets; none if it is not there."""
        held = self._manifest(version)["tables"].get(table, {})
        if held.get("segments"):
            return self._segments(held, table, schema).drop(SEGMENT, PART)
        paths = [p for b, p in sorted(held.get("buckets", {}).items()) if buckets is None or int(b) in buckets] + ([held["path"]] if "path" in held else [])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def parts(self, table: str, schema: str, version: int | None = None) -> tuple[DataFrame, int]:
        """(rows of a table of segments with the column PART of their key's bucket, number of buckets): a filter on PART prunes the scan."""
        held = self._manifest(version)["tables"].get(table, {})
        if not held.get("segments"):
            return self.spark.createDataFrame([], f"{schema}, {PART} int"), self.buckets
        return self._segments(held, table, schema).drop(SEGMENT), held["parts"]

    def _segments(self, held: dict, table: str, schema: str) -> DataFrame:
        read = self.spark.read.schema(f"{schema}, {SEGMENT} int, {PART} int").option("basePath", f"{self.root}/{table}")
        rows = read.parquet(*[f"{self.root}/{table}/{SEGMENT}={v}" for v in held["segments"]])
        if not held["dead"]:
            return rows
        owner = [f"{c} {t}" for c, t in held["owner"]]
        dead = self.spark.read.schema(", ".join([*owner, "until int"])).parquet(*held["dead"])
        names = [c for c, _ in held["owner"]]
        last = dead.groupBy(*names).agg(F.max("until").alias("until")).select(*[F.col(c).alias(f"dead_{c}") for c in names], "until")
        same = [F.col(c) == F.col(f"dead_{c}") for c in names]
        match = F.col(SEGMENT) < F.col("until")
        for s in same:
            match &= s
        return rows.join(last, match, "left_anti")

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets of the keys (first column) of some tables: at most as many numbers as there are buckets."""
        found: set[int] = set()
        for rows in keys:
            found |= {r[0] for r in rows.select(bucket(F.col(rows.columns[0]), self.buckets)).distinct().collect()}
        return sorted(found)

    # Writing ----------------------------------------------------------------------------------------------------------------

    def _write_parts(self, rows: DataFrame, key: str, path: str, names: tuple[str, ...] = (), parts: list[int] | None = None) -> None:
        dealt = rows.withColumn(PART, bucket(key, self.buckets))
        tasks = len(parts) if parts else self.buckets
        dealt.repartition(tasks, PART).sortWithinPartitions(PART, key, *names).write.mode("overwrite").partitionBy(PART).parquet(path)

    def _write(self, table: str, change: DataFrame | Buckets | Segment, held: dict, version: int) -> dict:
        if isinstance(change, Buckets):
            path = f"{self.root}/{table}/v{version}"
            self._write_parts(change.rows, change.key, path, parts=change.touched)
            kept = {} if change.touched is None else {b: p for b, p in held.get("buckets", {}).items() if int(b) not in change.touched}
            made = {n.rpartition("=")[2]: f"{path}/{n}" for n in self._list(path) if n.startswith(f"{PART}=")}
            return {"buckets": kept | made}
        if isinstance(change, Segment):
            old, dead = ([], []) if change.fresh else (held.get("segments", []), held.get("dead", []))
            owner = held.get("owner", [])
            rows = change.rows
            if change.dead is not None and old:
                path, owner = f"{self.root}/{table}/dead-v{version}", change.dead.dtypes
                change.dead.distinct().withColumn("until", F.lit(version)).write.mode("overwrite").parquet(path)
                dead = [*dead, path]
            if len(old) >= MOST_SEGMENTS:
                schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
                live = self._segments({"segments": old, "dead": dead, "owner": owner}, table, schema).drop(SEGMENT, PART)
                rows, old, dead = live.select(*rows.columns).unionByName(rows), [], []
            self._write_parts(rows, change.key, f"{self.root}/{table}/{SEGMENT}={version}")
            return {"segments": [*old, version], "dead": dead, "owner": [list(o) for o in owner], "parts": self.buckets}
        path = f"{self.root}/{table}/v{version}"
        change.write.mode("overwrite").parquet(path)
        return {"path": path}

    def commit(self, **tables: DataFrame | Buckets | Segment) -> int:
        """Writes ``tables`` as the next version; tables not named stay as they are. A failure leaves the old version."""
        now = self._manifest()
        version = now["version"] + 1
        self._claim(version)
        made = dict(now["tables"])
        try:
            for name, change in tables.items():
                made[name] = self._write(name, change, now["tables"].get(name, {}), version)
        except Exception:
            self.release()
            raise
        return self._publish(version, made)

    def reset(self, *keep: str) -> int:
        """Forgets all tables but ``keep``."""
        now = self._manifest()
        self._claim(now["version"] + 1)
        return self._publish(now["version"] + 1, {k: v for k, v in now["tables"].items() if k in keep})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes the manifests of all but the last ``keep`` versions, then the folders that no kept version refers to; their paths."""
        if keep < 1:
            raise ValueError("one version at least is kept")
        kept, gone, used, tables = self.versions()[-keep:], [], set(), set()
        for version in kept:
            for table, held in self._manifest(version)["tables"].items():
                used |= {*held.get("buckets", {}).values(), *held.get("dead", []), *([held["path"]] if "path" in held else [])}
                used |= {f"{self.root}/{table}/{SEGMENT}={v}" for v in held.get("segments", [])}
        for version in self.versions():
            if version not in kept:
                tables |= set(self._manifest(version)["tables"])
                self._delete(f"_versions/v{version}.json")
                self._delete(f"_claims/v{version}")
        for table in sorted(tables | {t for v in kept for t in self._manifest(v)["tables"]}):
            for name in self._list(table):
                path = f"{self.root}/{table}/{name}"
                inner = [f"{path}/{n}" for n in self._list(path) if n.startswith(f"{PART}=")] if name.startswith("v") else []
                stale = [p for p in inner if p not in used] if any(p in used for p in inner) else [] if path in used else [path]
                for p in stale:
                    self._delete(p)
                gone += stale
        return gone
