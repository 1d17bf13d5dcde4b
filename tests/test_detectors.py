import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgrid.operators.detectors import QualityConfig, anomaly_masks, annotate, calibration_table


def at(df, mask):
    t0 = datetime(2024, 1, 1)
    return sorted(int((r["timestamp"] - t0).total_seconds() // 3600) for r in df.where(mask).select("timestamp").collect())


def test_ramp_masks(spark, panel_of):
    xs = [float(i) for i in range(1, 31)]
    xs[5], xs[6], xs[7] = None, -2.0, math.inf
    df = anomaly_masks(panel_of({"b": xs}))
    assert at(df, "is_missing") == [5] and at(df, "is_negative") == [6] and at(df, "is_infinite") == [7]


def test_runs_and_outlier(panel_of):
    xs = [float(i) for i in range(1, 31)]
    xs[10:16] = [0.0] * 6
    xs[18:25] = [7.123] * 7
    xs[29] = 100000.0
    df = anomaly_masks(panel_of({"b": xs}), QualityConfig(long_zero_threshold=4, stuck_threshold=5, causal_window=12, level_shift_ratio=5.0))
    assert at(df, "is_long_zero") and at(df, "is_stuck") and 29 in at(df, "is_outlier")


@pytest.mark.parametrize(("mode", "want"), [("tail", [19]), ("whole_run", list(range(12, 20)))])
def test_stuck_flagging(panel_of, mode, want):
    xs = [float(i) for i in range(1, 41)]
    xs[12:20] = [7.5] * 8
    assert at(anomaly_masks(panel_of({"b": xs}), QualityConfig(run_flagging=mode)), "is_stuck") == want


def test_calibration_follows_resolution(panel_of):
    rng = random.Random(1)
    n = 24 * 42
    coarse = [float(i // 12 % 50 + 1) for i in range(n)]
    fine = [100 + rng.random() for _ in range(n)]
    for xs in (coarse, fine):
        xs[n - 100 : n - 92] = [77.25] * 8
    config = QualityConfig(run_flagging="whole_run", stuck_calibration_quantile=0.999, calibration_end="2024-02-05 00:00:00")
    panel = panel_of({"coarse": coarse, "fine": fine})
    thresholds = {r["building_id"]: r["stuck_threshold_effective"] for r in calibration_table(panel, config).collect()}
    assert thresholds["coarse"] > 8 and thresholds["fine"] == 8
    flagged = anomaly_masks(panel, config).where("is_stuck").groupBy("building_id").count().collect()
    assert {r[0]: r[1] for r in flagged} == {"fine": 8}


def test_frozen_thresholds(panel_of):
    config = QualityConfig(stuck_calibration_quantile=0.999, stuck_thresholds_by_building={"b": 8})
    row = calibration_table(panel_of({"b": [float(i % 7 + 1) for i in range(200)]}), config).first()
    assert row["calibration_source"] == "reference_calibration" and row["stuck_threshold_effective"] == 8


def test_profile_counts_rows(panel_of):
    df = annotate(panel_of({"b": list(range(672))}), QualityConfig(zero_profile_min_ratio=0.25, profile_weeks=3))
    rows = [r["profile"] for r in df.orderBy("timestamp").select("profile").collect()]
    assert all(x is None for x in rows[:336]) and rows[336] == 84.0


def test_zero_exemption_is_voted_by_run(panel_of):
    week = [100.0 + h % 10 if d < 5 and 8 <= h <= 17 else 0.0 for d in range(7) for h in range(24)]
    xs = week * 10
    outage = 9 * 168 + 24 + 10
    xs[outage : outage + 6] = [0.0] * 6
    config = QualityConfig(run_flagging="whole_run", zero_profile_min_ratio=0.25)
    flagged = at(anomaly_masks(panel_of({"b": xs}), config).where(F.col("timestamp") >= datetime(2024, 3, 4)), "is_long_zero")
    assert set(range(outage, outage + 6)) <= set(flagged)
    idle = 9 * 168 + 5 * 24
    assert not set(range(idle, idle + 24)) & set(flagged)


def test_future_does_not_reach_back(panel_of):
    rng = random.Random(2)
    xs = [50 + 10 * rng.random() for _ in range(200)]
    names = ["is_outlier", "is_level_shift", "is_stuck", "is_long_zero"]
    keep = lambda x: [tuple(r) for r in anomaly_masks(panel_of({"b": x})).where(F.col("timestamp") < datetime(2024, 1, 7)).orderBy("timestamp").select(*names).collect()]
    assert keep(xs) == keep(xs[:150] + [1e9] * 50)


def test_rows_without_timestamp_are_flagged_by_value_only(spark, panel_of):
    good = panel_of({"b": [10.0] * 3 + [11.0, 12.0, 13.0, 14.0, 15.0]})
    lost = good.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp_ntz")).withColumn("load", F.lit(-1e6))
    df = anomaly_masks(good.unionByName(lost))
    row = df.where("timestamp IS NULL").first()
    assert row["is_negative"] and not row["is_outlier"] and not row["is_level_shift"]
    plain = sorted(map(tuple, anomaly_masks(good).collect()))
    assert sorted(map(tuple, df.where("timestamp IS NOT NULL").collect())) == plain


def test_bad_configuration():
    for bad in ({"run_flagging": "x"}, {"stuck_calibration_quantile": 0}, {"zero_profile_min_ratio": -1}, {"profile_weeks": 0}):
        with pytest.raises(ValueError):
            QualityConfig(**bad)
