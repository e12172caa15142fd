"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from memquarry.plans import arrivals, jobs, moments  # noqa: F401
from memquarry.plans.queries import TABLE

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for n in NAMES:
        c.sql(f"CREATE VIEW {n} AS FROM '{SF}/{n}.parquet'")
    return c


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(str(tuple(r)) for r in frame.where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", list(TABLE))
def test_query(spark, db, name):
    f, sql = TABLE[name]
    got = f(spark, SF).toPandas()
    assert len(got.columns)
    if sql:
        expect = db.sql(sql).df()
        assert sorted(got.columns) == sorted(expect.columns)
        assert rows(got, sorted(got.columns)) == rows(expect, sorted(got.columns))


def test_diversity(spark):
    from pyspark.sql import functions as F

    from memquarry.operators.search import diversified

    near = [(1, i, f"f{i}", 1.0 - i / 100, "semantic", [1.0, 0.0] if i < 5 else [float(i % 2), float(i)], 9) for i in range(1, 10)]
    df = spark.createDataFrame(near, "query_id long, rank int, filename string, score double, dominant string, embedding array<double>, n long")
    got = df.groupBy("query_id").applyInPandas(diversified(4), "query_id long, rank int, filename string, score double, dominant string")
    assert got.where(F.col("filename").isin("f1", "f2", "f3", "f4")).count() == 4  # fewer than 3 differ: the list stays as it is


def test_calibrate(spark):
    """Worked by hand: ceiling 0.04 gives 0.08, above half of the weakest genuine match (0.06)."""
    from memquarry.operators.library import calibrate

    v = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "embedding array<double>")
    q = lambda *rows: spark.createDataFrame(list(rows), "query_id long, vec array<double>")
    noise, genuine = q((0, [0.04, 0.0]), (2, [-1.0, -1.0])), q((0, [0.1, 0.0]), (1, [0.03, 0.06]), (3, [0.001]), (5, None))
    get = lambda *a: [tuple(r) for r in calibrate(*a).collect()]
    assert get(v, noise) == [(0.08, 0.6)]
    assert get(v, noise, genuine) == [(0.03, 0.6)]
    assert get(v, noise, q((1, [0.5, 0.0]))) == [(0.08, 0.6)]
    assert get(v, noise, q((1, [-1.0, 0.0]))) == [(0.01, 0.6)]  # no match at all: the least floor
    assert get(v, q(), genuine) == []  # nothing to measure by
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.0])], "model_id string, embedding array<double>")
    assert sorted(get(two, noise, q((1, [0.08, 0.0])))) == [("a", 0.04, 0.6), ("b", 0.02, 0.6)]
    asked = spark.createDataFrame([(1, [0.08, 0.0], "a")], "query_id long, vec array<double>, model_id string")
    assert sorted(get(two, noise, asked)) == [("a", 0.04, 0.6), ("b", 0.04, 0.6)]
