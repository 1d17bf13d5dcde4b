"""Every query of the catalog against its oracle SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from loomgrid.plans import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"}).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"hist_gradient_boosting_fit", "random_forest_fit", "ridge_fit"}))
def test_query_runs_twice_alike(spark, name):
    a, b = (sorted(map(tuple, catalog.QUERIES[name](spark, DATA).collect()), key=str) for _ in range(2))
    assert a and a == b


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0
