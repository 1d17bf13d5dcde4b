import io
import json
import math
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import panel as P
from loomgrid.operators import verify
from loomgrid.operators import weather as W
from loomgrid.plans import forecasting, onboarding
from loomgrid.sources import readers, sinks

T0 = datetime(2016, 1, 1)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    rng = random.Random(0)
    n = 24 * 45
    hour = lambda i: (T0 + timedelta(hours=i)).strftime("%Y-%m-%d %H:%M:%S")
    lines = ["timestamp,b1,b2,b3"]
    for i in range(n):
        base = 50 + 10 * math.sin(2 * math.pi * i / 24) + i / 500
        lines.append(f"{hour(i)},{base + rng.random():.4f},{base * 2 + rng.random():.4f},{base * 3 + rng.random():.4f}")
    (d / "meters.csv").write_text("\n".join(lines) + "\n")
    (d / "metadata.csv").write_text("building_id,site_id,primaryspaceusage,timezone\nb1,site_a,Education,US/Eastern\nb2,site_b,Office,US/Eastern\nb3,site_c,Education,US/Eastern\nb9,site_c,Office,US/Eastern\n")
    head = "timestamp,site_id,airTemperature,cloudCoverage,dewTemperature,precipDepth1HR,seaLvlPressure,windSpeed"
    (d / "weather.csv").write_text("\n".join([head] + [f"{hour(i)},{s},{10 + i % 24},,{i % 5},0,1000,{i % 3}" for s in ("site_a", "site_b", "site_c") for i in range(5, n)]) + "\n")
    return d


def test_wide_selection_and_limit(spark, files):
    got = readers.ingest_selected(spark, str(files / "meters.csv"), str(files / "metadata.csv"), P.Selection(building_ids=("b1", "b3"), maximum_source_rows=25))
    assert got["panel"].count() == 50 and got["buildings"] == ["b1", "b3"]
    assert ("b9", "not_present_in_meter_header") in got["exclusions"]


def test_long_and_wide_agree(spark, files, tmp_path):
    wide = readers.meters(spark, str(files / "meters.csv"))
    assert wide.count() == 3 * 24 * 45
    rows = ["Datetime , Building,Meter_Reading"] + [f"{r['timestamp']},{r['building_id']},{r['load']}" for r in wide.limit(20).collect()] + ["not a time,b1,x"]
    (tmp_path / "long.csv").write_text("\n".join(rows) + "\n")
    long = readers.meters(spark, str(tmp_path / "long.csv"))
    assert long.columns == ["timestamp", "building_id", "load"] and long.count() == 21
    assert long.where("timestamp IS NULL AND load IS NULL").count() == 1


def test_bad_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("timestamp\n2016-01-01\n")
    for name in "ab":
        with pytest.raises(ValueError):
            readers.meters(spark, str(tmp_path / f"{name}.csv"))
    with pytest.raises(ValueError):
        readers.metadata(spark, str(tmp_path / "a.csv"))


def test_only_chosen_metadata_counts(spark, tmp_path):
    (tmp_path / "m.csv").write_text("timestamp,b1,b2\n2016-01-01 00:00:00,1,2\n2016-01-01 01:00:00,3,4\n")
    (tmp_path / "d.csv").write_text("building_id,site_id,primary_use\nb1,s,u\nb2,s,u\nb2,s,u\n")
    one = readers.ingest_selected(spark, str(tmp_path / "m.csv"), str(tmp_path / "d.csv"), P.Selection(building_ids=("b1",)))
    counts = {r["code"]: r["count"] for r in one["issues"].collect()}
    assert counts["METADATA_DUPLICATE_KEY"] == 0
    panel, issues = readers.ingest(spark, str(tmp_path / "m.csv"), str(tmp_path / "d.csv"))
    assert panel.count() == 4 and {r["code"]: r["count"] for r in issues.collect()}["METADATA_DUPLICATE_KEY"] == 2


def test_selection_rules(spark):
    m = spark.createDataFrame([("a1", "A", "x"), ("a2", "A", "x"), ("b1", "B", "x"), ("b2", "B", "y"), ("n", None, "x")], "building_id string, site_id string, primary_use string")
    chosen, out = P.select_entities(m, ["a1", "a2", "b1", "b2", "n"], P.Selection(maximum_building_count=4))
    assert chosen == ["a1", "b1", "b2", "n"] and out == [("a2", "maximum_building_count")]
    chosen, out = P.select_entities(m, ["a1", "b1"], P.Selection(site_ids=("B",)))
    assert chosen == ["b1"] and ("a1", "site_filter") in out
    for bad in (P.Selection(building_ids=("zz",)), P.Selection(maximum_building_count=0)):
        with pytest.raises(ValueError):
            P.select_entities(m, ["a1"], bad)


def test_contract(spark):
    text = spark.createDataFrame([("2016-01-01 00:00:00", " b ", "1.5"), ("x", "", "NaN")], "timestamp string, building_id string, load string")
    df = P.contract(text, "reference")
    rows = df.orderBy(F.asc_nulls_last("timestamp")).collect()
    assert (rows[0]["building_id"], rows[0]["load"]) == ("b", 1.5) and rows[1]["timestamp"] is None and rows[1]["load"] is None and rows[1]["building_id"] is None
    assert len(P.violations(df)) == 2
    assert P.violations(df.drop("load"))[0].startswith("columns")
    good = df.where("timestamp IS NOT NULL")
    assert P.violations(good, "reference") == [] and P.violations(good.unionByName(good)) == ["keys are not unique"]


def test_weather_grid(spark, files):
    w = readers.weather(spark, str(files / "weather.csv"))
    grid = W.prepare(w, ["site_a", "site_b"], "2016-01-01 00:00:00", "2016-01-03 23:00:00")
    assert grid.count() == 2 * 72 and grid.where("air_temperature IS NULL").count() == 10
    rates = {(r[0], r[1]): r[2] for r in W.missing_rates(grid).collect()}
    assert rates["site_a", "cloud_coverage"] == 1.0 and rates["site_a", "air_temperature"] == pytest.approx(5 / 72)
    assert W.violations(grid) == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b,c", None), (1, "a", float("nan"))], "k int, s string, v double")
    for n in ("x", "y"):
        sinks.export_csv_gz(df, str(tmp_path / f"{n}.csv.gz"), ["k"])
    a, b = ((tmp_path / f"{n}.csv.gz").read_bytes() for n in ("x", "y"))
    assert a == b and a[4:8] == b"\0\0\0\0"
    sinks.write_json(str(tmp_path / "j.json"), {"b": float("inf"), "a": T0})
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": "2016-01-01T00:00:00", "b": None}
    with pytest.raises(FileExistsError):
        sinks.empty_target(str(tmp_path))


def test_download_and_verify(spark, tmp_path):
    data = b"x" * 3_000_000
    import hashlib

    good = {"name": "f.bin", "url": "u", "size": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    got = readers.download([good], str(tmp_path), lambda u: io.BytesIO(data))
    assert got[0]["size"] == len(data)
    assert readers.download([good], str(tmp_path), lambda u: 1 / 0)[0]["sha256"] == good["sha256"]
    with pytest.raises(ValueError):
        readers.download([good | {"name": "g.bin", "sha256": "0"}], str(tmp_path), lambda u: io.BytesIO(data))
    assert [p.name for p in tmp_path.iterdir()] == ["f.bin"]
    assert readers.verify_many(spark, {str(tmp_path / "f.bin"): good["sha256"]}) == []
    assert readers.verify_many(spark, {str(tmp_path / "f.bin"): "0"}) == [str(tmp_path / "f.bin")]
    with pytest.raises(ValueError):
        readers.verify_file(str(tmp_path / "f.bin"), 1, None)


CONFIG = {
    "selection": {"maximum_building_count": 3},
    "quality": {"run_flagging": "whole_run", "stuck_calibration_quantile": 0.999, "zero_profile_min_ratio": 0.25, "profile_weeks": 3},
    "faults": {"cutoff": "2016-01-28T00:00:00Z", "seed": 12345, "severity": "low"},
    "remediation": {"maximum_forward_fill_hours": 3, "repair_strategy": "forward_then_profile", "profile_weeks": 3},
    "gate": {"check_thresholds": {"LOAD_MISSING": {"basis": "rate", "warn_above": 0, "fail_above": 0.05}}},
}


@pytest.fixture(scope="module")
def bundle(spark, files, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("bundle"))
    summary = onboarding.run(spark, CONFIG, str(files / "meters.csv"), str(files / "metadata.csv"), out, str(files / "weather.csv"))
    return out, summary


def test_onboarding_publishes_a_bundle_that_verifies(spark, bundle):
    out, summary = bundle
    assert summary["gate"]["status"] in ("pass", "warn") and summary["repair"].get("repaired", 0) > 0
    assert summary["gate"]["checks"] == 20
    assert onboarding.verify_bundle(spark, out) == []
    card, report = (Path(out, n).read_text() for n in ("data_card.md", "report.md"))
    assert "fault_keys" in card and "stuck_segment" in report


def test_published_conditions_fail_closed(spark, bundle, tmp_path):
    out, _ = bundle
    df = spark.read.parquet(f"{out}/conditions").where("condition = 'reference'").select("timestamp", "building_id", "load", "site_id", "primary_use", F.lit("reference").alias("condition"))
    df.write.parquet(str(tmp_path / "ok"))
    assert readers.condition(spark, str(tmp_path / "ok"), "reference").count() == df.count()
    with pytest.raises(ValueError):
        readers.condition(spark, str(tmp_path / "ok"), "corrupted")
    df.unionByName(df.limit(1)).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError):
        readers.condition(spark, str(tmp_path / "twice"), "reference")


def test_a_blocked_run_leaves_no_conditions(spark, files, tmp_path):
    lines = (files / "meters.csv").read_text().split("\n")
    lines[6] = lines[6].split(",")[0] + ",,1,1"
    (tmp_path / "m.csv").write_text("\n".join(lines))
    strict = CONFIG | {"gate": {"check_thresholds": {"LOAD_MISSING": {"basis": "count", "fail_above": 0}}}}
    out = tmp_path / "out"
    with pytest.raises(onboarding.Blocked):
        onboarding.run(spark, strict, str(tmp_path / "m.csv"), str(files / "metadata.csv"), str(out))
    assert (out / "blocked_run.json").exists() and not (out / "conditions").exists()
    with pytest.raises(FileExistsError):
        onboarding.run(spark, strict, str(tmp_path / "m.csv"), str(files / "metadata.csv"), str(out))


def test_wrong_source_is_refused(spark, files, tmp_path):
    with pytest.raises(onboarding.Blocked):
        onboarding.run(spark, CONFIG, str(files / "meters.csv"), str(files / "metadata.csv"), str(tmp_path / "o"), source_manifest={"electricity": {"size": 1, "sha256": None}})
    assert json.loads((tmp_path / "o" / "blocked_run.json").read_text())["reason_code"] == "SOURCE_IDENTITY"


FORECAST = {"models": ["seasonal_naive", "ridge"], "seed": 42, "bootstrap_repetitions": 10, "train_end": "2016-01-27T23:00:00", "validation_end": "2016-02-02T23:00:00"}


@pytest.mark.parametrize("direct", [False, True])
def test_forecast_of_a_bundle(spark, bundle, tmp_path, direct):
    out = str(tmp_path / "result")
    result = forecasting.run(spark, bundle[0], FORECAST | {"feature_set": "v2", "bootstrap_repetitions": 30}, out, direct=direct)
    metrics = spark.read.parquet(f"{out}/metrics").collect()
    assert len(metrics) == 6 and result["models"] == ["ridge", "seasonal_naive"]
    assert all(r["ci_low"] <= r["mae"] <= r["ci_high"] for r in metrics)
    assert "ridge" in Path(out, "report.md").read_text() and Path(out, "mae.svg").read_text().startswith("<svg")
    assert Path(out, "horizons.svg").exists() == direct
    if direct:
        assert spark.read.parquet(f"{out}/horizons").count() == 6 * 24
    else:
        subgroups = spark.read.parquet(f"{out}/subgroups")
        assert subgroups.where("ci_low <= mae AND mae <= ci_high").count() == subgroups.count() == 6 * (3 + 2 + 3 + 1)
    assert forecasting.verify_results(spark, out, bundle[0]) == []
    # forged cells with a manifest that agrees with them
    manifest, forged_tables = json.loads(Path(out, "run_manifest.json").read_text()), ["horizons", "paired_horizons"] if direct else ["macro_mase", "narrative", "subgroups"]
    for name in forged_tables:
        whole = spark.read.parquet(f"{out}/{name}")
        column = [c for c, t in whole.dtypes if t == "double"][-1]
        rows = [r.asDict() | ({column: (r[column] or 0.0) + 0.5} if k == 0 else {}) for k, r in enumerate(whole.collect())]
        spark.createDataFrame(rows, whole.schema).write.mode("overwrite").parquet(f"{out}/{name}")
        manifest["files"][name] = sinks.manifest_entry(spark.read.parquet(f"{out}/{name}"), name)
    sinks.write_json(f"{out}/run_manifest.json", manifest)
    assert sorted(forecasting.verify_results(spark, out, bundle[0])) == [f"{name}: does not follow from the predictions and the source" for name in forged_tables]
    forged = spark.read.parquet(f"{out}/metrics").withColumn("mae", F.col("mae") + 1).collect()
    types = spark.read.parquet(f"{out}/metrics").schema
    spark.createDataFrame(forged, types).write.mode("overwrite").parquet(f"{out}/metrics")
    assert len(forecasting.verify_results(spark, out)) == 2


def test_runs_leave_the_users_cache(spark, bundle):
    own = spark.range(10).cache()
    own.count()
    assert onboarding.verify_bundle(spark, bundle[0]) == []
    assert own.storageLevel.useMemory
    own.unpersist()


def test_unlogged_repairs_are_found(panel_of, spark):
    before, after = panel_of({"a": [1, 2, 3]}), panel_of({"a": [1, 5, 6]})
    log = after.where("load = 5").selectExpr("timestamp", "building_id", "2.0d AS original_value", "load AS remediated_value")
    assert [r["timestamp"].hour for r in verify.unlogged(before, after, log).collect()] == [2]


def test_config_errors():
    for bad in ({}, FORECAST | {"models": ["x"]}, FORECAST | {"feature_set": "v9"}):
        with pytest.raises(ValueError):
            forecasting.load_config(bad)


def test_streaming(spark, tmp_path):
    from loomgrid.streaming import panel as S

    rows = [(datetime(2024, 1, 1, h, m), "b", 1.0) for h in range(6) for m in (0, 30)]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = S.hourly(src, "ts", "k", "v", "1 hour").writeStream.format("memory").queryName("hours").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM hours ORDER BY timestamp").collect()
    assert [r["load"] for r in got] == [2.0] * 4

    loads = [None, 5.0, None, None, -3.0, None, 7.0]
    spark.createDataFrame([(datetime(2024, 1, 1, i), "b", x) for i, x in enumerate(loads)], "timestamp timestamp, building_id string, load double").coalesce(1).write.parquet(str(tmp_path / "p"))
    src = spark.readStream.schema("timestamp timestamp, building_id string, load double").parquet(str(tmp_path / "p"))
    q = S.forward_repair(src, 3).writeStream.format("memory").queryName("fixed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM fixed ORDER BY timestamp").collect()
    assert [r["load"] for r in got] == [None, 5.0, 5.0, 5.0, 5.0, None, 7.0]


def test_cli_arguments():
    from loomgrid.cli import parser

    a = parser().parse_args(["forecast", "--bundle", "b", "--config", "c", "--output", "o"])
    assert (a.command, a.bundle) == ("forecast", "b")


def test_reports():
    import xml.dom.minidom

    from loomgrid.sources import reports

    rows = [{"model": "a<b", "condition": c, "mae": v, "h": h} for c, v in (("x", 1.0), ("y", None)) for h in (1, 2)]
    for svg in (reports.bars(rows, "mae", "t & u"), reports.lines(rows, "h", "mae", "t"), reports.bars([], "mae", "none")):
        xml.dom.minidom.parseString(svg)
    assert reports.bars(rows, "mae", "t") == reports.bars(rows[::-1], "mae", "t")
    text = reports.findings([{"model": "m", "corruption_effect": 0.5, "repair_effect": None, "recovery": "partial"}])
    assert "+50.0 %" in text and "undefined" in text and "partial" in text
    assert reports.source_revision() == reports.source_revision()


def test_offsets_are_turned_to_utc(spark, tmp_path):
    times = ["2024-03-31 02:30:00", "2024-03-31T02:30:00Z", "2024-03-31T02:30:00+02:00", "2024-03-31 02:30:00.25-0530", "2024-03-31", "soon"]
    (tmp_path / "m.csv").write_text("timestamp,building_id,load\n" + "".join(f"{t},b,1\n" for t in times))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = [str(r[0]) for r in readers.meters(spark, str(tmp_path / "m.csv")).collect()]
            assert got == ["2024-03-31 02:30:00", "2024-03-31 02:30:00", "2024-03-31 00:30:00", "2024-03-31 08:00:00.250000", "2024-03-31 00:00:00", "None"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_the_row_limit_takes_the_first_rows_of_the_file(spark, tmp_path):
    lines = [f"2024-01-01 00:00:00,{i}" for i in range(3000)]
    (tmp_path / "w.csv").write_text("timestamp,b\n" + "\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = readers.selected_wide(spark, str(tmp_path / "w.csv"), ["b"], None, 700)
        assert sorted(r["load"] for r in got.collect()) == [float(i) for i in range(700)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_seeded_samples_are_marked(spark):
    log = spark.createDataFrame([("2024-01-01 00:00:00", "b", "corrupted"), ("2024-01-01 00:00:00", "b", "reference"), (None, None, "corrupted"), ("2024-01-01 01:00:00", "b", "corrupted")], "timestamp string, building_id string, source_condition string")
    faults = spark.createDataFrame([("2024-01-01 00:00:00", "b")] * 2, "timestamp string, building_id string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    got = onboarding.mark_seeded(log, faults).collect()
    assert sorted(r["seeded_fault"] for r in got) == [False, False, False, True]
    assert [r["source_condition"] for r in got if r["seeded_fault"]] == ["corrupted"]


def test_texts_are_written_again_over_themselves_and_read_from_any_store(spark, tmp_path):
    path = f"file://{tmp_path}/deep/j.json"
    for n in (1, 2):
        sinks.write_json(path, {"n": n})
        assert readers.read_json(path) == {"n": n}
    sinks.empty_target(f"file://{tmp_path}/new")
    with pytest.raises(FileExistsError):
        sinks.empty_target(f"file://{tmp_path}/deep")


def test_large_groups_take_the_poisson_form(spark, monkeypatch):
    rows = spark.createDataFrame([("m", float(i), f"2024-01-01 00:00:0{i}", "b") for i in range(5)], "model string, error double, timestamp string, building_id string")
    forms = []
    monkeypatch.setattr(forecasting.B, "poisson_bootstrap", lambda *a: forms.append("poisson"))
    monkeypatch.setattr(forecasting.B, "row_bootstrap", lambda *a: forms.append("exact"))
    raw = {"bootstrap_repetitions": 3, "seed": 1}
    for more in ({}, {"bootstrap_gather_rows": 4}, {"bootstrap": "exact", "bootstrap_gather_rows": 4}, {"bootstrap": "poisson"}):
        forecasting._interval({**raw, **more}, rows, "error", ["model"])
    assert forms == ["exact", "poisson", "exact", "poisson"]
