"""Every library query with SQL against DuckDB on the smallest tables, and the plans that matter."""

from pathlib import Path

import duckdb
import pytest

from lexframe import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


def rows(table):
    names = sorted(table.column_names)
    out = [tuple(round(v, 5) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in (r[n] for n in names)) for r in table.to_pylist()]
    return names, sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, duck, name):
    ours = queries.QUERIES[name](spark, str(DATA)).toArrow()
    assert ours.num_rows
    if name in queries.ORACLES:
        theirs = duck.sql(queries.ORACLES[name]).to_arrow_table()
        assert rows(ours) == rows(theirs)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(queries.bm25_topk(spark, str(DATA)))


def test_filters_and_columns_reach_the_scan(spark):
    found = plan(queries.filter_topics_repealed(spark, str(DATA)))
    assert "PushedFilters: [In(lang" in found or "PushedFilters: [In(source" in found or "In(source" in found
    assert "text" not in found.split("ReadSchema")[1].split("\n")[0]


def test_as_of_needs_one_exchange(spark):
    assert plan(queries.asof_version(spark, str(DATA))).count("Exchange hashpartitioning") == 1
