import math
from datetime import datetime, timedelta

import pytest

from loomgrid.operators.detectors import QualityConfig
from loomgrid.operators.repair import quarantine, repair, repair_log


def test_six_rows_with_boundary(panel_of):
    df = repair(panel_of({"b": [None, 5, None, 7, -9, 1000]}), repair_before="2024-01-01 04:00:00")
    got = [r["load"] for r in df.orderBy("timestamp").collect()]
    assert got[0] is None and got[1:4] == [5, 5, 7] and got[4:] == [-9, 1000]


def test_twenty_hour_gap(panel_of):
    n = 24 * 35
    xs = [10.0 + i % 24 for i in range(n)]
    xs[n - 60 : n - 40] = [None] * 20
    df = repair(panel_of({"b": xs}), QualityConfig(level_shift_ratio=1e9, outlier_mad_z=1e9), strategy="forward_then_profile").persist()
    log = repair_log(df)
    rules = {r["rule"][:16]: r["count"] for r in log.groupBy("rule").count().collect()}
    assert rules == {"past_only_forwar": 3, "past_only_hour_o": 17} and quarantine(df).count() == 0
    cut = datetime(2024, 1, 1) + timedelta(hours=n - 50)
    later = repair(panel_of({"b": xs}), QualityConfig(level_shift_ratio=1e9, outlier_mad_z=1e9), strategy="forward_then_profile", repair_before=str(cut))
    assert all(r["load"] is None for r in later.where(f"timestamp >= timestamp_ntz '{cut}' AND original_value IS NULL").collect())


def test_ambiguous_scale(panel_of):
    xs = [100 + 20 * math.sin(i / 4) for i in range(24 * 28)]
    xs[600:608] = [x * 100 for x in xs[600:608]]
    base = panel_of({"b": xs})
    hit = "original_value > 1000"
    assert all(r["status"] == "quarantined" for r in repair(base, strategy="forward_then_profile").where(hit).collect())
    allowed = repair(base, strategy="forward_then_profile", profile_fills_ambiguous=True).where(hit).collect()
    assert allowed and all(r["status"] == "repaired" and r["load"] < 200 for r in allowed)


def test_zero_is_not_filled_with_zero(panel_of):
    xs = [10.0 + i % 5 for i in range(30)] + [0.0] * 9 + [12.0] * 3
    df = repair(panel_of({"b": xs}), QualityConfig(run_flagging="whole_run"))
    assert all(r["load"] != 0.0 for r in df.where("status = 'repaired'").collect())


def test_missing_site_is_quarantined_and_counts_in_the_run(spark, panel_of):
    from pyspark.sql import functions as F

    df = panel_of({"b": [5.0, 6.0, 7.0, None, None, None]})
    df = df.withColumn("site_id", F.when(F.hour("timestamp") != 2, F.col("site_id")))
    got = {r["timestamp"].hour: (r["status"], r["load"], r["reason"]) for r in repair(df, forward_hours=3).collect()}
    assert got[2] == ("quarantined", None, "missing_metadata")
    assert got[3][:2] == ("repaired", 6.0) and got[4][:2] == ("repaired", 6.0) and got[5][0] == "quarantined"


def test_key_set_and_log_agree(panel_of):
    xs = [float(i % 9) for i in range(100)]
    xs[40] = None
    p = panel_of({"a": xs, "b": xs})
    df = repair(p)
    assert df.count() == p.count()
    assert repair_log(df).count() == df.where("status IN ('repaired', 'quarantined')").count()


@pytest.mark.parametrize("bad", [{"forward_hours": -1}, {"strategy": "x"}, {"profile_hours": -1}, {"profile_weeks": 0}])
def test_bad_parameters(panel_of, bad):
    with pytest.raises(ValueError):
        repair(panel_of({"b": [1.0]}), **bad)


def test_against_a_sequential_repair(panel_of):
    """The window plan equals a loop with the same state on random rows."""
    import random
    from collections import defaultdict, deque
    from statistics import median

    rng = random.Random(3)
    xs = [None if rng.random() < 0.3 else round(20 + rng.random(), 3) for _ in range(900)]
    config = QualityConfig(stuck_threshold=10**6, level_shift_ratio=1e9, outlier_mad_z=1e9)
    got = repair(panel_of({"b": xs}), config, strategy="forward_then_profile", forward_hours=2, profile_hours=3, profile_weeks=4, repair_before="2024-02-04 00:00:00")
    rows = [(r["status"], r["load"]) for r in got.orderBy("timestamp").collect()]
    last, run, past, want = None, 0, defaultdict(lambda: deque(maxlen=4)), []
    for i, x in enumerate(xs):
        t = datetime(2024, 1, 1) + timedelta(hours=i)
        slot = t.weekday() * 24 + t.hour
        if t >= datetime(2024, 2, 4):
            want.append(("protected", x))
            if x is not None:
                last, run = x, 0
            continue
        if x is not None and x >= 0:
            last, run = x, 0
            past[slot].append(x)
            want.append(("valid", x))
            continue
        run += 1
        if last is not None and run <= 2:
            want.append(("repaired", last))
        elif run <= 3 and len(past[slot]) >= 2:
            want.append(("repaired", median(past[slot])))
        else:
            want.append(("quarantined", None))
    assert rows == want
