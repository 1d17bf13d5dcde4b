import pytest
from pyspark.sql import functions as F

from loomgrid.operators import faults as FA
from loomgrid.operators import verify

CUT = "2024-01-20 00:00:00"


@pytest.fixture(scope="module")
def panel(panel_of):
    n = 24 * 30
    return panel_of({b: [50 + k + i % 24 + (i % 7) / 10 for i in range(n)] for k, b in enumerate("abc")}).withColumn("condition", F.lit("reference")).persist()


def test_same_seed_same_faults_and_keys_stay(panel):
    a, b = (FA.inject(panel, cutoff=CUT, seed=7, severity="low") for _ in range(2))
    assert sorted(map(tuple, a.faults.collect()), key=str) == sorted(map(tuple, b.faults.collect()), key=str)
    assert {r[0] for r in a.faults.select("fault_type").distinct().collect()} == set(FA.FAMILIES)
    assert a.faults.count() == 3 + 3 * 4
    assert verify.key_difference(panel, a.frame).isEmpty()
    assert FA.after_cutoff(a.faults, CUT).isEmpty()
    assert verify.documented_changes(panel, a.frame, a.faults).isEmpty()
    assert verify.bind_faults(a.faults, panel, a.frame).isEmpty()
    assert verify.parity(panel, a.frame, CUT).isEmpty()
    assert FA.stale_metadata(a.faults).isEmpty()


def test_many_events_never_share_a_key(panel):
    got = FA.inject(panel, cutoff=CUT, seed=1, severity="low", events_per_type=3).faults
    assert got.select("fault_id").distinct().count() == 18
    assert got.count() == got.select("timestamp", "building_id").distinct().count()
    uniform = FA.inject(panel, cutoff=CUT, seed=1, severity="low", events_per_type=dict.fromkeys(FA.FAMILIES, 3)).faults
    assert sorted(map(tuple, uniform.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_values_of_families(panel):
    rows = FA.inject(panel, cutoff=CUT, seed=3, severity="medium").faults.collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["timestamp"]):
        first.setdefault(r["fault_id"], r["original_value"])
    for r in rows:
        x, y = r["original_value"], r["corrupted_value"]
        want = {
            "missing_value": None, "negative_value": -x - 1, "positive_spike": x * 30, "long_zero_block": 0.0,
            "stuck_segment": first[r["fault_id"]] * 0.731 + 0.123, "unit_scale_segment": x * 100,
        }[r["fault_type"]]
        assert y == want if want is None else y == pytest.approx(want)


def test_structural_suite_and_confusion(panel):
    suite = FA.inject_structural(panel, cutoff=CUT, seed=5, severity="low")
    kinds = {r[0] for r in suite.faults.select("fault_type").distinct().collect()}
    assert kinds == {*FA.FAMILIES, "missing_interval", "duplicate_key", "timestamp_shift", "metadata_mismatch"}
    assert suite.frame.count() == panel.count()
    rows = {r["fault_type"]: r for r in FA.confusion(suite.frame, suite.faults).collect()}
    assert len(rows) == 10
    for kind in ("missing_value", "negative_value", "duplicate_key", "metadata_mismatch", "missing_interval", "positive_spike"):
        assert rows[kind]["recall"] == 1.0, kind
    assert all(r["true_positive"] + r["false_negative"] > 0 for r in rows.values())


def test_tampering_shows(panel):
    suite = FA.inject(panel, cutoff=CUT, seed=9, severity="low")
    forged = suite.frame.withColumn("load", F.when((F.col("building_id") == "a") & (F.hour("timestamp") == 3) & (F.dayofmonth("timestamp") == 25), 1.0).otherwise(F.col("load")))
    assert verify.documented_changes(panel, forged, suite.faults).where("kind = 'undocumented'").count() == 1
    assert verify.parity(panel, forged, CUT).count() == 1
    assert verify.documented_changes(panel, panel, suite.faults).where("kind = 'ineffective'").count() > 0
    stale = suite.faults.withColumn("affected_key_count", F.lit(99))
    assert FA.stale_metadata(stale).count() == suite.faults.count()
    digest = verify.content_digest
    assert digest(panel) == digest(panel.repartition(7)) != digest(forged)


@pytest.mark.parametrize("bad", [0, {"missing_value": 0}, {"x": 1}])
def test_bad_counts(bad):
    with pytest.raises(ValueError):
        FA.event_counts(bad)


def test_too_short_for_a_block(panel_of):
    with pytest.raises(ValueError):
        FA.inject(panel_of({"a": [1.0, 2.0, 3.0, 4.0, 5.0]}), cutoff=CUT, seed=1)


def test_draws_are_uniform_over_what_is_free(spark, panel_of):
    """Intervals on the driver equal a list of all candidates with the taken ones struck out."""
    import numpy as np

    xs = [float(i % 9 + 1) if i % 37 else 0.0 for i in range(300)]
    panel = panel_of({"a": xs, "b": xs[:100], "c": [1.0] * 7})
    rows = FA._numbered(panel, CUT, 4).persist()
    pick, rng = FA._Candidates(rows, np.random.default_rng(4), 4), np.random.default_rng(4)
    known = sorted((r["building_id"], r["position"], r["starts_block"]) for r in rows.collect())
    cells, starts = [(b, p) for b, p, _ in known], [(b, p) for b, p, ok in known if ok]
    taken = set()
    for k in range(40):
        size, pool = (1, cells) if k % 2 else (4, starts)
        free = [(b, p) for b, p in pool if not any((b, p + i) in taken for i in range(size))]
        want = free[int(rng.integers(0, len(free)))]
        assert (pick.single() if size == 1 else pick.block()) == want
        taken |= {(want[0], want[1] + i) for i in range(size)}
