import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators.panel import round_robin
from loomgrid.operators.quantiles import exact_medians


@pytest.mark.parametrize("most", [5, 40, 100_000])
def test_medians_are_exact_however_few_values_a_task_may_hold(spark, most):
    rng = np.random.default_rng(1)
    n = 4001
    a = np.exp(rng.normal(size=n) * 5)
    b = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 10)  # a hot value off the middle
    c = np.where(rng.random(n) < 0.7, 0.0, rng.normal(size=n))  # the middle is one value
    rows = [(i, float(x), float(y), float(z), None, float(i) if i < 10 else None) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, none double, few double").repartition(4)
    got = exact_medians(df, {k: F.col(k) for k in ("i", "a", "b", "c", "none", "few")}, most)
    want = {"i": 2000.0, "a": np.median(a), "b": np.median(b), "c": 0.0, "few": 4.5}
    assert got.pop("none") is None
    assert got == pytest.approx(want, rel=1e-15)


def test_medians_of_even_counts_and_no_rows(spark):
    df = spark.range(1, 5000).select((F.col("id") * 2).alias("v"))
    assert exact_medians(df, {"v": F.col("v")}, 10) == {"v": 5000.0}
    assert exact_medians(df.where("v < 2000 AND v > 10"), {"v": F.col("v")}, 10) == {"v": 1005.0}
    assert exact_medians(df.where("v < 0"), {"v": F.col("v")}) == {"v": None}
    assert exact_medians(df, {}) == {}


def test_places_follow_turn_site_and_use(spark):
    rows = [("b3", "s1", "u"), ("b1", "s1", "u"), ("b2", None, "u"), ("b4", "s0", None), ("b5", "s0", None), ("b6", "s1", "u"), ("b1", "s1", "u")]
    got = round_robin(spark.createDataFrame(rows, "building_id string, site_id string, primary_use string"))
    assert [r["building_id"] for r in got.orderBy("place").collect()] == ["b4", "b1", "b2", "b5", "b3", "b6"]
    assert [r["place"] for r in got.orderBy("place").collect()] == [1, 2, 3, 4, 5, 6]
