"""Panels are dealt into tasks by their rows, and sorted no more often than the plan needs."""

import re

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import windows
from loomgrid.operators.detectors import anomaly_masks
from loomgrid.operators.repair import repair
from loomgrid.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sorts(df):
    """Sorts of the panel's rows, by entity and something more."""
    return len(re.findall(r" Sort \[building_id#\d+ ASC NULLS FIRST, ", plan(df)))


def tasks_and_most(df):
    counts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return df.rdd.getNumPartitions(), max(r["count"] for r in counts)


@pytest.mark.parametrize("what", [anomaly_masks, repair])
def test_tasks_grow_with_the_rows_and_hold_no_more(panel_of, monkeypatch, what):
    monkeypatch.setattr(windows, "TASK_ROWS", 500)
    small, large = (tasks_and_most(what(panel_of({f"b{i}": [float(k) for k in range(25)] for i in range(n)}))) for n in (40, 400))
    assert (small[0], large[0]) == (2, 20)
    assert max(small[1], large[1]) < 2 * 500


def test_a_panel_hashed_before_is_not_moved_again(panel_of):
    panel = windows.by_entity(panel_of({"a": [1.0, 2.0], "b": [3.0]}), 7)
    assert plan(repair(panel, tasks=7)).count("Exchange hashpartitioning") == 1


def test_many_entity_repair_plan(spark, monkeypatch):
    """One sort an order: times, times with undated rows first, hours of the week, their ordinals; lineitem crosses the network once."""
    monkeypatch.setattr(windows, "TASK_ROWS", 1000)
    df = catalog.QUERIES["many_entity_repair"](spark, DATA)
    assert sorts(df) == 4
    assert plan(df).count("REPARTITION_BY_NUM") == 1
    assert df.rdd.getNumPartitions() == windows.tasks_for(spark.read.parquet(f"{DATA}/lineitem.parquet").count())


def test_many_entity_masks_plan(spark, monkeypatch):
    """One sort for all masks, and lineitem crosses the network once."""
    monkeypatch.setattr(windows, "TASK_ROWS", 1000)
    df = catalog.QUERIES["many_entity_masks"](spark, DATA)
    assert sorts(df) == 1
    assert plan(df).count("REPARTITION_BY_NUM") == 1
    assert df.rdd.getNumPartitions() == windows.tasks_for(spark.read.parquet(f"{DATA}/lineitem.parquet").count())


def test_positions_inside_runs(spark, panel_of):
    from loomgrid.operators.detectors import QualityConfig, annotate

    xs = [0.0, 0.0, 5.0, 5.0, 5.0, None, 5.0, 0.0, 7.0, 7.0]
    got = annotate(panel_of({"a": xs, "b": xs}), QualityConfig()).orderBy("building_id", "timestamp").select("zero_position", "repeat_position").collect()
    want = [(1, 0), (2, 0), (0, 0), (0, 1), (0, 2), (0, 0), (0, 0), (1, 0), (0, 0), (0, 1)]
    assert [tuple(r) for r in got] == want * 2


@pytest.mark.parametrize("what", [anomaly_masks, repair])
def test_columns_of_the_panel_are_kept(panel_of, what):
    panel = panel_of({"a": [1.0, 2.0, 3.0]}).withColumns({"place": F.hour("timestamp") * 10, "bad_rows": F.lit(7)})
    assert sorted(tuple(r) for r in what(panel).select("place", "bad_rows").collect()) == [(0, 7), (10, 7), (20, 7)]
