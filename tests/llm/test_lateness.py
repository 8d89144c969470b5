import datetime as dt
import hashlib
import math
import random
import uuid
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexframe.llm import lateness
from lexframe.llm.common import scratch_dir

DATA = Path("/root/testdata/sf0.001/sales.parquet")
EPOCH, CUTOFF = dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 20)
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def us(t):
    return "" if t is None else str((t - EPOCH) // dt.timedelta(microseconds=1))


def day(t):
    return -1 if t is None else (t - EPOCH).days


def plain(sales, files=1100):
    """{(day, file_no): (rows in order, rewritten)} of the last layout, all in memory."""
    size, rows = 1 + len(sales) // files, list(sales)
    for r in sales:
        h = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        if h % 3 == 0 and day(r[4]) % 4 == 0:
            later = lambda t, n: None if t is None else t + dt.timedelta(days=n)
            rows.append((*r[:3], None if r[3] is None else r[3] + 1, later(r[4], h % 2), later(r[5], 1 + h % 97), r[6]))
    early = lambda r: r[5] is not None and r[5] < CUTOFF
    first, last = {}, {}
    for r in rows:
        for kept, ok in ((first, early(r)), (last, True)):
            if ok and (r[0] not in kept or (r[5] or dt.datetime.min, r[4] or dt.datetime.min) > (kept[r[0]][5] or dt.datetime.min, kept[r[0]][4] or dt.datetime.min)):
                kept[r[0]] = r
    dirty = {day(r[4]) for r in last.values() if not early(r)} | {day(first[k][4]) for k, r in last.items() if not early(r) and k in first}
    out, by_day = {}, {}
    for r in last.values():
        by_day.setdefault(day(r[4]), []).append(r)
    for d, own in by_day.items():
        own.sort(key=lambda r: (r[4] or dt.datetime.min, -1 if r[0] is None else r[0]))
        for k in range(0, len(own), size):
            out[d, k // size] = own[k : k + size], d in dirty
    return out


def check(found, expected, root):
    assert {(r["day"], r["file_no"]) for r in found} == set(expected)
    for r in found:
        own, rewritten = expected[r["day"], r["file_no"]]
        assert r["n_rows"] == len(own) and r["rewritten"] == rewritten
        assert r["cents"] == sum(math.floor(100 * x[3] + 0.5) for x in own if x[3] is not None)
        assert r["rows_crc"] == sum(zlib.crc32(f"{'' if x[0] is None else x[0]}:{us(x[4])}:{us(x[5])}".encode()) for x in own)
        assert r["ids_sha256"] == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in own).encode()).hexdigest()
        table = pq.ParquetFile(r["path"].removeprefix("file:")).read()
        assert ",".join(table.column_names) == r["columns"] and table["sale_id"].to_pylist() == [x[0] for x in own]
    there = {str(p) for p in Path(root.removeprefix("file:")).rglob("*.parquet")}
    assert there == {"/" + r["path"].removeprefix("file:").lstrip("/") for r in found}


def fresh(spark):
    return f"{scratch_dir(spark)}/sales-{uuid.uuid4().hex}"


def random_sales(n, seed):
    """Hot moments, null and far times, days that empty when their rows move."""
    rng = random.Random(seed)
    start, hot = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 2, 5)
    rows = []
    for i in range(n):
        sold = hot if rng.random() < 0.4 else None if rng.random() < 0.05 else start + dt.timedelta(seconds=rng.randrange(120 * 86400), microseconds=rng.randrange(10**6))
        tied = zlib.crc32(str(i * 7 % (n + 1)).encode()) % 3 == 0  # a copy that arrives as late as its original
        arrived = None if rng.random() < 0.05 and not tied else (sold or start) + dt.timedelta(seconds=rng.randrange(40 * 86400))
        rows.append((i * 7 % (n + 1), i, "x", None if rng.random() < 0.1 else rng.randrange(10**5) / 100, sold, arrived, 1))
    rows += [(900_000, 1, "a", 1.0, dt.datetime(1969, 12, 31, 23), dt.datetime(2024, 1, 1), 1), (900_001, 1, "a", 1.0, dt.datetime(2024, 5, 30), dt.datetime(2024, 3, 1), 1), (900_001, 1, "b", 2.0, dt.datetime(2024, 5, 29), dt.datetime(2024, 4, 1), 1)]
    return rows


@pytest.mark.parametrize("files", [3, 200])
def test_whole_results_against_plain(spark, files):
    rows, root = random_sales(1200, files), fresh(spark)
    found = lateness.sales_layout(spark.createDataFrame(rows, SCHEMA), root, files=files).collect()
    check(found, plain(rows, files), root)


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
def test_given_table(spark):
    root, rows = fresh(spark), pq.read_table(DATA).to_pylist()
    found = lateness.sales_layout(spark.read.parquet(str(DATA)), root).collect()
    check(found, plain([tuple(r.values()) for r in rows]), root)


def test_untouched_files_stay_as_they_are(spark, monkeypatch):
    rows, root, seen = [(i, 1, "x", 1.0, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i % 240), dt.datetime(2024, 1, 20) if i % 240 < 200 else dt.datetime(2024, 4, 1), 1) for i in range(500)], fresh(spark), {}
    written = lateness.DayLayout.overwrite

    def spy(self, kept):
        seen.update({p: p.read_bytes() for p in Path(root.removeprefix("file:")).rglob("*.parquet")})
        written(self, kept)

    monkeypatch.setattr(lateness.DayLayout, "overwrite", spy)
    found = lateness.sales_layout(spark.createDataFrame(rows, SCHEMA), root, files=50).collect()
    kept = [Path("/" + r["path"].removeprefix("file:").lstrip("/")) for r in found if not r["rewritten"]]
    assert kept and all(seen[p] == p.read_bytes() for p in kept)
    assert any(r["rewritten"] for r in found)


def test_hot_hours_and_moments_are_split(spark):
    """Cells are as small as files, and ranks run through."""
    rows = spark.range(5000).select(F.lit(3).cast("long").alias("day"), F.when(F.col("id") < 3000, 10).otherwise(F.col("id") * 1000).cast("long").alias("at"), (5000 - F.col("id")).alias("key"), F.struct(F.col("id").alias("id")).alias("row"))
    ranked = lateness.day_ranks(rows, 100)
    got = [r["key"] for r in ranked.orderBy("rank").collect()]
    assert got == [k for _, k in sorted((r["at"], r["key"]) for r in rows.collect())]
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(5000))


def test_clashing_names_and_an_empty_table(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 5, "a", 3), (1, dt.datetime(2024, 1, 3), dt.datetime(2024, 5, 2), 6, "b", 4), (None, None, None, 7, None, None)], "key long, at timestamp_ntz, hour timestamp_ntz, day int, row string, rank int")
    layout, start = lateness.overwrite_late(rows, fresh(spark), 10, "2024-03-01", "key", "at", "hour")
    back = layout.read(spark)
    assert back.columns == [*rows.columns, "day_", "file_no"] and start.count() == 1
    assert sorted((r["day"], r["row"] or "", r["day_"]) for r in back.collect()) == [(6, "b", 19725), (7, "", -1)]
    assert lateness.sales_layout(spark.createDataFrame([], SCHEMA), fresh(spark)).collect() == []
