"""A layout of days in files of equal length, and its overwrite when rows arrive late.

Every key keeps its latest-arrived row. A day's rows, ordered by time and key, are cut into Parquet files of ``rows_per_file``
rows. A row's file follows from its rank within the day, and ranks are hierarchical, so that no task ever sees a whole day:
rows are counted by day and hour; hours with more rows than a file are split at quantiles of their times, and a single moment
with more rows than a file at quantiles of its keys. Cumulative sums over these counts give each such cell its offset, a
``row_number`` within the cell the rest. Counts are what is small: some 24 cells a day and a few for each file.

Late rows make the days dirty in which they come to lie and the days in which their keys lay before. Only those are ranked
again and written, by a dynamic overwrite of their partitions; files beyond a day's new end go afterwards. Other files are not
touched. The same call repeated gives the same layout, so an overwrite that was broken off is simply run again; readers should
wait until it returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, discard

NO_DAY = -1
SLICES = 256
MOST_CELLS = 100_000
_LEAST = -(2**63)


def days(time: Column) -> Column:
    """Whole days since 1970; ``NO_DAY`` for null."""
    return F.coalesce(F.date_diff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long"), F.lit(NO_DAY).cast("long"))


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp as it is written, whatever the session's zone; null for null."""
    day = F.date_diff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (day * 24 + F.hour(time)) * 3600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def _small(table: DataFrame) -> DataFrame:
    """``table`` marked for broadcast if it has few rows; else Spark shuffles it."""
    return F.broadcast(table) if table.count() <= MOST_CELLS else table


def _pick(quantiles: Column, parts: Column) -> Column:
    """The inner bounds of ``parts`` equal parts, from SLICES - 1 quantiles, each once."""
    at = F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(2)) - 1), lambda i: F.element_at(quantiles, F.greatest(F.lit(1), (i * F.lit(SLICES) / F.greatest(parts, F.lit(2))).cast("int"))))
    return F.array_sort(F.array_distinct(at))


def _bounds(rows: DataFrame, cells: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """(keys, bounds): where the cells with more than ``most`` rows are to be split by ``value``."""
    hot = cut(cells.where(F.col("n") > most).select(*keys, F.least(F.ceil(F.col("n") / most), F.lit(SLICES)).cast("int").alias("parts")), "hot-cells")
    ranks = F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)])
    found = rows.join(_small(hot), keys).groupBy(*keys, "parts").agg(F.percentile_approx(value, ranks, F.lit(20 * SLICES)).alias("q"))
    return cut(found.select(*keys, _pick(F.col("q"), F.col("parts")).alias("bounds")), "cell-bounds")


def day_ranks(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (day long, at long, key long, row struct) with ``rank`` long, gapless from 0 within a day in the order of at and key,
    nulls first. Cells have about ``most`` rows at the most, unless rows are equal in both."""
    base = rows.withColumn("t", F.coalesce("at", F.lit(_LEAST))).withColumn("id", F.coalesce("key", F.lit(_LEAST)))
    base = base.withColumn("hour", F.when(F.col("at").isNull(), -1).otherwise(F.pmod(F.floor(F.col("at") / 3_600_000_000), F.lit(24))).cast("int"))
    keys = ["day", "hour"]
    cells = cut(base.groupBy(*keys).agg(F.count("*").alias("n")), "day-hours")
    if cells.where(F.col("n") > most).limit(1).count():
        hours = _bounds(base, cells, keys, "t", most)
        sub = 2 * F.size(F.filter("bounds", lambda b: b < F.col("t"))) + F.array_contains("bounds", F.col("t")).cast("int")
        base = base.join(_small(hours), keys, "left").withColumn("sub", F.coalesce(F.when(F.col("bounds").isNotNull(), sub), F.lit(0))).drop("bounds")
        keys = [*keys, "sub"]
        cells = cut(base.groupBy(*keys).agg(F.count("*").alias("n"), (F.min("t") == F.max("t")).alias("one")), "day-subranges")
        moments = cells.where("one")
        if moments.where(F.col("n") > most).limit(1).count():
            slices = _bounds(base, moments, keys, "id", most)
            part = F.size(F.filter("bounds", lambda b: b < F.col("id")))
            base = base.join(_small(slices), keys, "left").withColumn("slice", F.coalesce(F.when(F.col("bounds").isNotNull(), part), F.lit(0))).drop("bounds")
            keys = [*keys, "slice"]
            cells = cut(base.groupBy(*keys).agg(F.count("*").alias("n")), "day-slices")
    before = Window.partitionBy("day").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("t", "id"))
    return base.withColumn("local", local).join(_small(cut(offsets, "cell-offsets")), keys).withColumn("rank", F.col("offset") + F.col("local") - 1).select(*rows.columns, "rank")


def latest(rows: DataFrame, key: str, time: str, arrival: str, cutoff: str) -> DataFrame:
    """(key, first, last): of each key the row that had arrived last before ``cutoff`` (or null), and the one that did so in the end.

    A row without an arrival counts as late and as the earliest of its key. Rows that arrived together are told apart by time,
    then by a hash of all columns. Rows of one key are reduced in each task before they are shuffled.
    """
    row, arrived = F.struct(*[F.col(c) for c in rows.columns]), micros(F.col(arrival))
    order = F.struct(F.coalesce(arrived, F.lit(_LEAST)).alias("a"), F.coalesce(micros(F.col(time)), F.lit(_LEAST)).alias("t"), F.xxhash64(*rows.columns).alias("h"))
    early = arrived < micros(F.lit(cutoff).cast("timestamp_ntz"))
    found = rows.select(F.col(key).cast("long").alias("key"), row.alias("row"), order.alias("order"), F.coalesce(early, F.lit(False)).alias("early"))
    first = F.max_by(F.when(F.col("early"), F.col("row")), F.when(F.col("early"), F.col("order")))
    return found.groupBy("key").agg(first.alias("first"), F.max_by("row", "order").alias("last"), F.max_by("early", "order").alias("early"))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


@dataclass(frozen=True)
class DayLayout:
    """A folder ``root`` of files ``day=…/file_no=…/part-….parquet`` with the data columns only. The folders' names get an
    underscore where a data column has the same name."""

    root: str
    schema: StructType
    key: str
    time: str
    rows_per_file: int

    @property
    def parts(self) -> list[str]:
        names = self.schema.names
        return [_free("day", names), _free("file_no", names)]

    def read(self, spark) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields, *[StructField(p, LongType()) for p in self.parts]])).parquet(self.root)

    def write(self, kept: DataFrame, row: str) -> DataFrame:
        """Writes the rows (structs) of ``kept`` and replaces the files of the same days and numbers; gives (day, files) of what was written."""
        at = F.col(f"{row}.{self.time}")
        rows = kept.select(days(at).alias("day"), micros(at).alias("at"), F.col(f"{row}.{self.key}").cast("long").alias("key"), F.col(row).alias("row"))
        placed = day_ranks(rows, self.rows_per_file).withColumn("file", F.floor(F.col("rank") / F.lit(self.rows_per_file)))
        tasks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = placed.repartition(tasks, "day", "file").sortWithinPartitions("day", "file", "rank")
        data = [F.col(f"row.`{c}`").alias(c) for c in self.schema.names]
        out = dealt.select(*data, F.col("day").alias(self.parts[0]), F.col("file").alias(self.parts[1]))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts).parquet(self.root)
        return rows.groupBy("day").agg(F.ceil(F.count("*") / F.lit(self.rows_per_file)).alias("files"))

    def overwrite(self, kept: DataFrame) -> None:
        """Makes the layout of ``first`` rows that of ``last`` rows; ``kept`` is what ``latest`` gives."""
        spark = kept.sparkSession
        day = lambda row: days(F.col(f"{row}.{self.time}"))
        late = kept.where("not early")
        both = late.select(F.explode(F.array_distinct(F.array(F.when(F.col("first").isNotNull(), day("first")), day("last")))).alias("day")).where("day is not null")
        dirty = cut(both.groupBy("day").count().select("day"), "dirty-days")
        written = self.write(kept.withColumn("day", day("last")).join(_small(dirty), "day", "left_semi"), "last")
        ends = dirty.join(written, "day", "left").select("day", F.coalesce("files", F.lit(0)).alias("files"))
        fs, path = None, spark._jvm.org.apache.hadoop.fs.Path
        for d, files in ends.toLocalIterator():  # one row a calendar day
            folder = path(f"{self.root}/{self.parts[0]}={d}")
            fs = fs or folder.getFileSystem(spark._jsc.hadoopConfiguration())
            if not fs.exists(folder):
                continue
            if not files:
                fs.delete(folder, True)
                continue
            for status in fs.listStatus(folder):
                if int(status.getPath().getName().rpartition("=")[2]) >= files:
                    fs.delete(status.getPath(), True)
        discard(dirty)

    def paths(self, spark) -> DataFrame:
        """(path) of the files that are there now, kept as a table."""
        return cut(self.read(spark).select(F.col("_metadata.file_path").alias("path")).distinct(), "layout-paths")


def _file_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a file, from rows that come file by file, in order: counts, sums and a running hash of the ids."""
    names = ["path", "day", "file_no", "n_rows", "cents", "rows_crc", "ids_sha256"]
    now, head, n, cents, crc, sha = None, None, 0, 0, 0, None

    def done() -> pa.RecordBatch:
        values = [now, *head, n, cents, crc, sha.hexdigest()]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    for batch in batches:
        path, at = batch.column(0), 0
        while at < batch.num_rows:
            own = path[at].as_py()
            if own != now:
                if now is not None:
                    yield done()
                now, head, n, cents, crc, sha = own, (batch.column(1)[at].as_py(), batch.column(2)[at].as_py()), 0, 0, 0, hashlib.sha256()
            other = pc.index(pc.not_equal(path.slice(at), own), True).as_py()
            size = batch.num_rows - at if other < 0 else other
            ids = batch.column(3).slice(at, size)
            sha.update((("," if n else "") + ",".join(["" if i is None else i for i in ids.to_pylist()])).encode())
            cents += pc.sum(batch.column(4).slice(at, size)).as_py()
            crc += pc.sum(batch.column(5).slice(at, size)).as_py()
            n, at = n + size, at + size
    if now is not None:
        yield done()


def file_digests(layout: DayLayout, spark, key: str, cents: Column, crc: Column) -> DataFrame:
    """(path, day, file_no, n_rows, cents, rows_crc, ids_sha256) of every file, as read back; a file is one streaming pass in its row order."""
    read = layout.read(spark)
    rows = read.select(F.col("_metadata.file_path").alias("path"), F.col(layout.parts[0]).alias("day"), F.col(layout.parts[1]).alias("file_no"), F.col(key).cast("string").alias("id"), cents.alias("cents"), crc.alias("crc"), F.col("_metadata.row_index").alias("nth"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "path").sortWithinPartitions("path", "nth").drop("nth")
    return dealt.mapInArrow(_file_digests, "path string, day long, file_no long, n_rows long, cents long, rows_crc long, ids_sha256 string")


def overwrite_late(rows: DataFrame, root: str, rows_per_file: int, cutoff: str, key: str, time: str, arrival: str) -> tuple[DayLayout, DataFrame]:
    """Lays out in ``root`` the rows that arrived before ``cutoff``, then all rows; gives the layout and the first one's paths.

    ``rows`` must give the same rows each time it is read. ``key`` is an integer column, ``time`` and ``arrival`` are timestamps. Null times lie in the day
    ``NO_DAY``, first in order; null arrivals are late; a null key is a key like any other; repeated rows are one row; an
    empty table gives an empty folder. Columns may have any names.
    """
    spark = rows.sparkSession
    kept = cut(latest(rows, key, time, arrival, cutoff), "latest-rows")
    layout = DayLayout(root, rows.schema, key, time, rows_per_file)
    layout.write(kept.where("first is not null"), "first")
    start = layout.paths(spark)
    layout.overwrite(kept)
    discard(kept)
    return layout, start


def sales_layout(sales: DataFrame, root: str, cutoff: str = "2024-03-20 00:00:00", files: int = 1100) -> DataFrame:
    """The contract's rows for ``sales``: some sales are corrected by a later copy, the layout is written as of ``cutoff``, then overwritten."""
    spark, columns = sales.sparkSession, sales.columns
    n = sales.count()
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    shifted = lambda c, by: F.col(c) + F.make_dt_interval(by.cast("int"))
    made = {"total": F.col("total") + 1, "sold_at": shifted("sold_at", h % 2), "arrived_at": shifted("arrived_at", 1 + h % 97)}
    copies = sales.where((h % 3 == 0) & (days(F.col("sold_at")) % 4 == 0)).select(*[made.get(c, F.col(c)).alias(c) for c in columns])
    layout, start = overwrite_late(sales.unionByName(copies), root, 1 + n // files, cutoff, "sale_id", "sold_at", "arrived_at")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cents = F.coalesce(F.floor(F.col("total") * 100 + 0.5).cast("long"), F.lit(0))
    crc = F.crc32(F.concat_ws(":", text(F.col("sale_id")), text(micros(F.col("sold_at"))), text(micros(F.col("arrived_at")))).cast("binary"))
    data = [c for c in layout.read(spark).columns if c not in layout.parts]
    found = file_digests(layout, spark, "sale_id", cents, crc).join(start.withColumn("old", F.lit(True)), "path", "left")
    return found.select("day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(",".join(data)).alias("columns"), "ids_sha256", F.col("old").isNull().alias("rewritten"))
