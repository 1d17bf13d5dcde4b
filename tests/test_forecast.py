import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import bootstrap as B
from loomgrid.operators import direct as D
from loomgrid.operators import evaluate as E
from loomgrid.operators import features as FE
from loomgrid.operators import models as M
from loomgrid.operators import split


def wave(n, k):
    return [100 + k + 10 * math.sin(2 * math.pi * i / 24) + 5 * math.cos(2 * math.pi * i / 168) for i in range(n)]


@pytest.fixture(scope="module")
def panel(panel_of):
    return panel_of({"b1": wave(840, 0), "b2": wave(840, 7)}).persist()


def test_lag_and_rolling_borders(panel):
    df = FE.load_features(panel, "v3").where("building_id = 'b1'").orderBy("timestamp").collect()
    assert df[23]["lag_24"] is None and df[24]["lag_24"] == df[0]["load"]
    assert df[28]["rolling_mean_24"] is None
    assert df[29]["rolling_mean_24"] == pytest.approx(np.mean([r["load"] for r in df[:6]]))


def test_features_do_not_see_the_last_day(panel):
    cut = datetime(2024, 1, 25)
    changed = panel.withColumn("load", F.when(F.col("timestamp") >= cut, 1e6).otherwise(F.col("load")))
    names = FE.numeric_columns("v3")
    early = lambda df: [tuple(r) for r in FE.build(df, feature_set="v3").where(F.col("timestamp") < F.lit(cut) + F.expr("INTERVAL 24 HOURS")).orderBy("building_id", "timestamp").select(*names).collect()]
    assert early(panel) == early(changed)


def test_calendar(panel):
    rows = {r["timestamp"]: r for r in FE.calendar_features(panel.where("building_id = 'b1'"), "v3").collect()}
    assert rows[datetime(2024, 1, 1, 5)]["is_us_federal_holiday"] == 1.0
    assert rows[datetime(2024, 1, 3)]["is_us_federal_holiday"] == 0.0 and rows[datetime(2024, 1, 3)]["is_weekend"] == 0.0
    assert rows[datetime(2024, 1, 6)]["is_weekend"] == 1.0


def test_observed_holidays():
    from datetime import date

    from loomgrid.functions.scalars import federal_holidays

    days = federal_holidays(2016, 2021)
    assert date(2016, 12, 26) in days and date(2016, 12, 25) not in days
    assert date(2021, 6, 18) in days and date(2020, 6, 19) not in days


def test_grid_is_asserted(panel):
    with pytest.raises(ValueError):
        FE.build(panel.where("hour(timestamp) <> 5"))


def frame(spark, rows, names="target double, prediction double"):
    return spark.createDataFrame(rows, names)


def test_metric_set(spark):
    row = E.metrics(frame(spark, [(10.0, 11.0), (20.0, 18.0), (30.0, 33.0)]), 2.0, []).first()
    assert (row["n"], row["mae"], row["mase"]) == (3, 2.0, 1.0)
    assert row["rmse"] == pytest.approx(math.sqrt(14 / 3)) and row["wmape"] == pytest.approx(0.1) and row["r2"] == pytest.approx(0.93)


def test_metrics_of_a_constant_target(spark):
    row = E.metrics(frame(spark, [(5.0, 4.0), (5.0, 6.0), (None, 1.0), (3.0, float("nan"))]), None, []).first()
    assert row["n"] == 2 and row["r2"] is None and row["mase"] is None


def test_scales_and_macro(spark, panel_of):
    train = panel_of({"A": [1, 2, 3, 4], "B": [10, 14, 18, 22], "C": [5, 5, 5, 5], "D": [1]})
    scales = {r[0]: r[1] for r in E.entity_scales(train, 2).collect()}
    assert scales == {"A": 2.0, "B": 8.0, "C": None, "D": None}
    p = spark.createDataFrame([("A", 2.0, 4.0), ("B", 10.0, 14.0), ("C", 1.0, 2.0)], "building_id string, target double, prediction double")
    per = E.entity_mase(p, E.entity_scales(train, 2), [])
    assert {r["building_id"]: r["mase"] for r in per.collect()} == {"A": 1.0, "B": 0.5, "C": None}
    row = E.macro_mase(per, []).first()
    assert (row["macro_mase"], row["buildings_evaluated"], row["buildings_undefined"]) == (0.75, 2, 1)
    cover = E.scale_coverage(E.entity_scales(train, 2)).first()
    assert cover["valid_scale_buildings"] == "A;B" and cover["undefined_scale_buildings"] == "C;D"


def paired(spark, y, c, r):
    rows = [(datetime(2024, 1, 1, i), "b", "m", k, p, t) for i, t in enumerate(y) for k, p in (("corrupted", c[i]), ("remediated", r[i]))]
    return E.paired_rows(spark.createDataFrame(rows, "timestamp timestamp_ntz, building_id string, model string, condition string, prediction double, target double"))


def test_paired_difference(spark):
    p = paired(spark, [10.0, 20.0, 30.0], [14.0, 18.0, 35.0], [11.0, 18.0, 32.0])
    row = E.paired_difference(p).first()
    assert row["corrupted_mae"] == pytest.approx(11 / 3) and row["remediated_mae"] == pytest.approx(5 / 3) and row["mean_difference"] == pytest.approx(-2)
    ci = B.row_bootstrap(p, "difference", ["model"], ["timestamp"], 1, 1, by_index=True).first()
    assert ci["ci_low"] == pytest.approx(-2) == ci["ci_high"]


def test_blocked_paired_difference(spark):
    p = paired(spark, [10.0, 20.0, 30.0, 40.0], [14.0, 25.0, 36.0, 48.0], [11.0, 22.0, 33.0, 44.0])
    row = E.paired_difference(p).first()
    assert (row["corrupted_mae"], row["remediated_mae"], row["mean_difference"]) == (5.75, 2.5, -3.25)
    blocks = p.withColumn("block", F.when(F.hour("timestamp") < 2, "A").otherwise("B"))
    ci = B.block_bootstrap(blocks, "difference", "block", ["model"], 50, 3).first()
    assert ci["ci_low"] <= -3.25 <= ci["ci_high"]
    assert ci == B.block_bootstrap(blocks.repartition(3), "difference", "block", ["model"], 50, 3).first()


def test_bootstrap_kernels():
    low, high = B.block_interval(np.array([4.0, 24.0]), np.array([2.0, 2.0]), 50, 1)
    assert low <= 7 <= high and (low, high) == B.block_interval(np.array([4.0, 24.0]), np.array([2.0, 2.0]), 50, 1)
    rng = np.random.default_rng(5)
    x = np.arange(10.0)
    want = np.quantile([rng.choice(x, size=10, replace=True).mean() for _ in range(20)], [0.025, 0.975])
    assert B.row_interval(x, 20, 5, False) == tuple(want)


def test_poisson_bootstrap_is_near(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, "g", rng.gauss(5, 2)) for i in range(2000)], "i int, g string, v double")
    ci = B.poisson_bootstrap(rows, "v", ["g"], ["i"], 200, 1).first()
    assert ci["ci_low"] < 5.1 and ci["ci_high"] > 4.9 and 0.1 < ci["ci_high"] - ci["ci_low"] < 0.3


def test_direct_examples(panel):
    df = D.examples(panel).persist()
    assert df.count() == 34 * 24 * 2
    row = df.where("building_id = 'b1' AND horizon_hours = 5").orderBy("forecast_origin").collect()[10]
    loads = wave(840, 0)
    at = int((row["target_timestamp"] - datetime(2024, 1, 1)).total_seconds() // 3600)
    assert row["condition_target"] == loads[at] and row["direct_lag_24"] == loads[at - 24] and row["direct_lag_168"] == loads[at - 168]
    labels = D.origin_partitions(df, split.Split("2024-01-20 23:00:00", "2024-01-28 22:00:00", "2024-02-04 23:00:00"))
    assert {r[0] for r in labels.select("partition").distinct().collect()} == {"train", "validation", "test", "excluded_boundary_straddle"}


def test_direct_features_stop_at_the_origin(panel):
    cut = datetime(2024, 1, 25)
    changed = panel.withColumn("load", F.when(F.col("timestamp") >= cut, 1e6).otherwise(F.col("load")))
    own = [c for c in D.NUMERIC]
    early = lambda df: [tuple(r) for r in D.examples(df).where(F.col("forecast_origin") < F.lit(cut)).orderBy("building_id", "forecast_origin", "horizon_hours").select(*own).collect()]
    assert early(panel) == early(changed)


def test_complete_vectors(spark):
    rows = [
        (datetime(2024, 1, o, 23), h, datetime(2024, 1, o + 1, (h + 23) % 24), "b", c, m)
        for o in (1, 2) for h in range(1, 25) for c in ("reference", "corrupted", "remediated") for m in ("x", "y") if not (o == 2 and h == 24 and m == "y")
    ]
    df = spark.createDataFrame(rows, "forecast_origin timestamp_ntz, horizon_hours int, target_timestamp timestamp_ntz, building_id string, condition string, model string")
    kept = E.complete_vectors(df, 6)
    assert kept.count() == 144 and kept.select("forecast_origin").distinct().count() == 1


def test_fault_boundary():
    D.assert_cutoff("2024-01-21 00:00:00", "2024-01-20 23:00:00")
    with pytest.raises(ValueError):
        D.assert_cutoff("2024-01-21 01:00:00", "2024-01-20 23:00:00")


def test_splits(panel):
    s = split.by_fractions(panel, 0.6, 0.2)
    assert {r[0]: r[1] for r in split.counts(panel, s).collect()} == {"train": 1008, "validation": 336, "test": 336}
    with pytest.raises(ValueError):
        split.explicit(panel, "2024-01-20 23:00:00", "2024-01-10 23:00:00")
    with pytest.raises(ValueError):
        split.by_fractions(panel, 0.9, 0.2)


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2)) * [3, 0.5] + [1, -2]
    y = x @ [2.0, -3.0] + 5 + rng.normal(size=200)
    rows = [(datetime(2024, 1, 1 + i // 24, i % 24), "b", "s", "u", float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, building_id string, site_id string, primary_use string, f1 double, f2 double, load double")
    got = M.fit_predict(df, df, "ridge", M.ModelConfig(), ["f1", "f2"]).orderBy("timestamp").collect()
    z = (x - x.mean(0)) / x.std(0)
    z1 = np.c_[z, np.ones((200, 3))]  # one-hot columns of single values
    zc, yc = z1 - z1.mean(0), y - y.mean()
    w = np.linalg.solve(zc.T @ zc + np.eye(5), zc.T @ yc)
    assert np.allclose([r["prediction"] for r in got], zc @ w + y.mean(), atol=1e-4)


def test_naive_and_unknown_categories(panel):
    df = FE.build(panel).persist()
    train, test = df.where("timestamp < timestamp_ntz '2024-01-25'"), df.where("timestamp >= timestamp_ntz '2024-01-25'").withColumn("site_id", F.lit("new"))
    naive = M.fit_predict(train, test, "seasonal_naive", M.ModelConfig(), [])
    assert naive.where("prediction IS NULL").isEmpty()
    got = M.fit_predict(train, test, "random_forest", M.ModelConfig(n_trees=3, forest_depth=4), FE.numeric_columns())
    assert got.count() == test.count() and got.where("prediction IS NULL OR isnan(prediction)").isEmpty()


@pytest.mark.parametrize("name", ["hist_gradient_boosting", "random_forest"])
def test_registered_fits_are_not_cut(spark, monkeypatch, name):
    from loomgrid.plans import catalog

    seen = []
    monkeypatch.setattr(M, "fit_predict", lambda train, test, model, config, numeric: seen.append(M.estimator(model, config, 1, 1.0)))
    catalog.QUERIES[f"{name}_fit"](spark, "/root/testdata/sf0.001")
    (got,) = seen
    if name == "random_forest":
        assert (got.getNumTrees(), got.getMaxDepth(), got.getMinInstancesPerNode()) == (200, 30, 5)
    else:
        assert (got.getMaxIter(), got.getStepSize(), got.getMaxDepth()) == (120, 0.07, 5)


@pytest.mark.parametrize("name, form", [("bootstrap_ci", "row_bootstrap"), ("block_bootstrap_ci", "block_bootstrap"), ("poisson_bootstrap_ci", "poisson_bootstrap")])
def test_registered_bootstraps_draw_500_times(spark, monkeypatch, name, form):
    import inspect

    from loomgrid.plans import catalog

    seen, own = [], inspect.signature(getattr(B, form))
    monkeypatch.setattr(B, form, lambda *a, **k: seen.append(own.bind(*a, **k).arguments["repetitions"]))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [500]
