from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import quality as Q
from loomgrid.operators.detectors import QualityConfig


def by_code(df):
    return {r["code"]: r for r in df.collect()}


def test_counts_and_order_of_a_bad_ramp(spark, panel_of):
    xs = [float(i) for i in range(1, 31)]
    xs[5], xs[6], xs[7] = None, -2.0, float("inf")
    p = panel_of({"b": xs}).withColumn("_row", F.hour("timestamp") + F.dayofmonth("timestamp") * 24)
    p = p.withColumn("site_id", F.when(F.col("_row") != 32, F.col("site_id")))
    p = p.unionByName(p.where("_row = 34").withColumn("_row", F.lit(999)))
    got = by_code(Q.quality_checks(p, order_by="_row"))
    assert len(got) == 15
    assert [got[c]["count"] for c in ("LOAD_MISSING", "NEGATIVE_LOAD", "LOAD_INFINITE", "DUPLICATE_OBSERVATION_KEY", "METADATA_JOIN_MISSING", "TIMESTAMP_ORDER_ERROR")] == [1, 1, 1, 2, 1, 1]
    assert got["DUPLICATE_OBSERVATION_KEY"]["status"] == "fail" and got["METADATA_JOIN_MISSING"]["status"] == "fail"
    assert got["DUPLICATE_OBSERVATION_KEY"]["denominator"] == 31 and len(got["DUPLICATE_OBSERVATION_KEY"]["sample"]) == 2


def test_threshold_is_strict(panel_of):
    xs = [float(i + 5) for i in range(20)]
    for i in (3, 9, 12):
        xs[i] = None
    issues = Q.quality_checks(panel_of({"b": xs}))
    rate = lambda warn, fail: by_code(Q.apply_thresholds(issues, {"LOAD_MISSING": {"basis": "rate", "warn_above": warn, "fail_above": fail}}))["LOAD_MISSING"]
    row = rate(0.1, 0.2)
    assert (row["status"], row["count"], row["denominator"], row["rate"]) == ("warn", 3, 20, 0.15)
    assert rate(0.15, 0.2)["status"] == "pass" and rate(0.0, 0.14)["status"] == "fail"


def test_hard_codes_cannot_be_eased(panel_of):
    p = panel_of({"b": [1.0, 2.0, 3.0]})
    issues = Q.quality_checks(p.unionByName(p))
    eased = Q.apply_thresholds(issues, {"DUPLICATE_OBSERVATION_KEY": {"basis": "count", "fail_above": 1000}})
    assert by_code(eased)["DUPLICATE_OBSERVATION_KEY"]["status"] == "fail"
    row = Q.gate(eased).first()
    assert row["status"] == "fail" and "DUPLICATE_OBSERVATION_KEY" in row["hard_failures"]


@pytest.mark.parametrize("rule", [{"X": {}}, {"LOAD_MISSING": 3}, {"LOAD_MISSING": {"basis": "x"}}, {"LOAD_MISSING": {"warn_above": -1}}, {"LOAD_MISSING": {"warn_above": 2}}, {"LOAD_MISSING": {"warn_above": "a"}}, {"LOAD_MISSING": {"warn_above": 0.5, "fail_above": 0.1}}, {"LOAD_MISSING": {"basis": "count", "warn_above": float("nan")}}])
def test_bad_rules(rule):
    with pytest.raises(ValueError):
        Q.check_rules(rule)


def test_missing_column(panel_of):
    rows = Q.quality_checks(panel_of({"b": [1.0]}).drop("load")).collect()
    assert len(rows) == 1 and rows[0]["code"] == "SCHEMA_REQUIRED_COLUMN_MISSING" and rows[0]["columns"] == ["load"]


def test_split_coverage(panel_of):
    p = panel_of({"b1": [1.0] * 20, "b2": [1.0] * 5})
    p = p.withColumn("primary_use", F.when(F.col("building_id") == "b1", "Office").otherwise("School"))
    got = by_code(Q.split_checks(p, "2024-01-01 10:00:00"))
    assert (got["SPLIT_BUILDING_COVERAGE"]["count"], got["SPLIT_BUILDING_COVERAGE"]["denominator"], got["SPLIT_BUILDING_COVERAGE"]["status"]) == (1, 2, "fail")
    assert got["SUBGROUP_SPLIT_COVERAGE"]["count"] == 1 and got["SUBGROUP_SPLIT_COVERAGE"]["sample"] == [{"site_id": "s", "primary_use": "School", "timezone": "UTC"}]


def test_gaps(panel_of):
    p = panel_of({"b": [1.0] * 10, "c": [1.0] * 4}).where((F.hour("timestamp") != 4) | (F.col("building_id") == "c"))
    assert {r[0]: tuple(r)[1:] for r in Q.gaps(p).collect()} == {"b": (10, 9, 1), "c": (4, 4, 0)}


def test_issue_log_has_counters_once(panel_of):
    issues = Q.quality_checks(panel_of({"b": [None] * 9}))
    log = [r for r in Q.issue_log(issues).collect() if r["code"] == "LOAD_MISSING"]
    assert len(log) == 5 and [r["count"] for r in sorted(log, key=lambda r: r["sample_index"])] == [9, None, None, None, None]


def test_metadata_and_instability(spark, panel_of):
    m = spark.createDataFrame([("a", "s", "u"), ("a", "s", "u"), (None, "s", "u"), ("b", None, "u")], "building_id string, site_id string, primary_use string")
    got = by_code(Q.metadata_checks(m))
    assert [got[c]["count"] for c in ("METADATA_DUPLICATE_KEY", "METADATA_MISSING_KEY", "METADATA_REQUIRED_VALUE_MISSING")] == [2, 1, 1]
    p = panel_of({"b": [1.0, 2.0]}).withColumn("site_id", F.hour("timestamp").cast("string"))
    assert by_code(Q.quality_checks(p))["SUBGROUP_METADATA_INSTABILITY"]["count"] == 1


def test_coverage(panel_of):
    got = {(r["dimension"], r["value"]): r["rows"] for r in Q.coverage(panel_of({"b": [1.0] * 3}, start="2024-02-29T22:00:00")).collect()}
    assert got == {("site_id", "s"): 3, ("primary_use", "Office"): 3, ("season", "winter"): 2, ("season", "spring"): 1, ("timezone", "UTC"): 3}


def test_empty_panel(panel_of):
    got = by_code(Q.quality_checks(panel_of({"b": [1.0]}).where(F.col("timestamp") < datetime(2000, 1, 1))))
    assert len(got) == 15 and all(r["count"] == 0 for r in got.values())
    _ = QualityConfig()
