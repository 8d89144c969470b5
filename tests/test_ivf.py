import numpy as np
from pyspark.sql import functions as F

from lexframe.operators import dense, ivf


def table(spark, x, name="embedding"):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], f"vec_id long, {name} array<float>")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 5)) for r in df.collect())


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(20, 16))
    return [c + rng.normal(size=16) * 0.15 for c in centres[rng.integers(0, 20, n)]]


def test_equal_to_a_search_over_all_vectors(spark, tmp_path):
    x = clustered(3000, 1)
    x[100:140] = [x[5]] * 40  # ties
    x[7] = None
    vectors, queries = table(spark, x), table(spark, [*clustered(12, 2), x[5], None], "query_vector").withColumnRenamed("vec_id", "query_id")
    index, report = ivf.build(vectors, str(tmp_path / "ivf"), cells=40), ivf.Report()
    found = rows(index.search(queries, 10, report=report))
    assert found == rows(dense.search(vectors, queries, 10)) and len(found) == 130
    assert 0 < report.cells <= report.of_cells and report.compared < 0.2 * report.of_compared and report.of_compared == 13 * 2999
    plan = index.rows.where(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_whatever_the_centroids_are(spark, tmp_path):
    """Vectors without clusters, more neighbours than a cell holds, few vectors, none."""
    rng = np.random.default_rng(3)
    queries = table(spark, rng.normal(size=(6, 8)), "query_vector").withColumnRenamed("vec_id", "query_id")
    for n, cells, k in ((400, 30, 50), (3, 5, 10), (0, 4, 5), (60, 1, 7)):
        vectors = table(spark, rng.normal(size=(n, 8)))
        index = ivf.build(vectors, str(tmp_path / f"{n}"), cells=cells)
        assert rows(index.search(queries, k)) == rows(dense.search(vectors, queries, k))
