"""Every query with SQL gives the SQL's rows on the smallest tables; the others run and give rows."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = [n for n in QUERIES if n != "pipeline" and not n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    def plain(x):
        if isinstance(x, np.ndarray):
            return str(x.tolist())
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return format(x + 0.0, ".9g") if isinstance(x, (float, np.floating)) else str(x)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in OWN if n in SQL])
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in OWN if n not in SQL])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_round_trips_lose_nothing(spark):
    assert QUERIES["call_transform_stats"](spark, DATA).where("not lossless").count() == 0


def test_upper_median(spark):
    """Of drawn values with ties, zeros and single rows, by key and of all."""
    from bytewren.operators import vectors

    rng = np.random.default_rng(63)
    rows = [(int(k), float(x)) for k, x in zip(rng.integers(0, 5, 400), np.round(rng.exponential(3.0, 400), 1))] + [(9, 2.5), (8, 0.0), (8, 0.0)]
    df = spark.createDataFrame(rows, "k int, x double")
    upper = lambda xs: sorted(xs)[len(xs) // 2]
    found = {r.k: r.median for r in vectors.upper_median(df, "x", "k").collect()}
    assert found == {k: upper([x for j, x in rows if j == k]) for k in {k for k, _ in rows}}
    assert [r.median for r in vectors.upper_median(df, "x").collect()] == [upper([x for _, x in rows])]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(SQL) <= set(QUERIES)
