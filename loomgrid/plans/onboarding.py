"""From raw files to three published conditions, behind a gate.

The run has few actions: the gate's issue table, the fault draws, the
invariants and the writes. Conditions between them are cached or written once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import faults as FA
from ..operators import quality as Q
from ..operators import verify
from ..operators import weather as W
from ..operators.detectors import QualityConfig, calibration_table
from ..operators.panel import Selection, average_duplicates, contract, violations
from ..operators.repair import quarantine, repair, repair_log
from ..schemas import KEYS
from ..sources import readers, reports, sinks


class Blocked(RuntimeError):
    """The gate or a contract stopped the publication."""


@dataclass
class Config:
    quality: QualityConfig
    selection: Selection
    gate_rules: dict[str, Any]
    cutoff: str
    seed: int
    severity: str
    events_per_type: Any
    repair: dict[str, Any]
    timestamp_column: str | None = None

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Config:
        """From the JSON configuration's sections."""
        q, s, f = dict(raw.get("quality", {})), dict(raw.get("selection", {})), dict(raw.get("faults", {}))
        known = {k: v for k, v in q.items() if k in QualityConfig.__dataclass_fields__}
        chosen = {k: (tuple(v) if isinstance(v, list) else v) for k, v in s.items() if k in Selection.__dataclass_fields__}
        names = {
            "maximum_forward_fill_hours": "forward_hours", "repair_strategy": "strategy", "maximum_profile_fill_hours": "profile_hours",
            "profile_weeks": "profile_weeks", "profile_fill_ambiguous_scale": "profile_fills_ambiguous",
        }
        fixes = {names[k]: v for k, v in raw.get("remediation", {}).items() if k in names}
        cutoff = str(f["cutoff"]).replace("T", " ").removesuffix("Z").removesuffix("+00:00")
        known.setdefault("calibration_end", cutoff)
        return cls(
            QualityConfig(**known), Selection(**chosen), dict(raw.get("gate", {}).get("check_thresholds") or {}), cutoff,
            int(f.get("seed", 0)), str(f.get("severity", "medium")), f.get("events_per_type", 1), fixes,
            raw.get("dataset", {}).get("timestamp_column"),
        )


def frozen(panel: DataFrame, config: QualityConfig, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, QualityConfig]:
    """Thresholds measured once on the reference, then fixed for all conditions: a table that joins the panels."""
    if config.stuck_calibration_quantile is None:
        return calibration_table(panel, config), config
    measured = calibration_table(panel, config).select("building_id", F.col("stuck_threshold_effective").alias("stuck_threshold"))
    fixed = replace(config, stuck_thresholds_by_building=kept(measured))
    return calibration_table(panel, fixed), fixed


def checked(panel: DataFrame, config: Config, quality: QualityConfig, source: str, extra: DataFrame | None = None, order_by: str | None = None) -> DataFrame:
    issues = Q.quality_checks(panel, quality, source=source, order_by=order_by).unionByName(Q.split_checks(panel, config.cutoff, source=source))
    issues = issues.unionByName(extra) if extra is not None else issues
    return Q.apply_thresholds(issues, config.gate_rules)


def mark_seeded(log: DataFrame, faults: DataFrame) -> DataFrame:
    """The issue log with seeded_fault: the sample's key is one of the injected faults, in the corrupted condition."""
    keys = faults.select(F.col("timestamp").cast("string").alias("timestamp"), "building_id").distinct().withColumn("hit__", F.lit(True))
    marked = log.join(keys, ["timestamp", "building_id"], "left")
    seeded = F.coalesce(F.col("hit__"), F.lit(False)) & (F.col("source_condition") == "corrupted")
    return marked.select(*log.columns, seeded.alias("seeded_fault"))


def run(spark: SparkSession, raw_config: dict[str, Any], meter_csv: str, metadata_csv: str, output: str, weather_csv: str | None = None, source_manifest: dict[str, Any] | None = None) -> dict[str, Any]:
    """Publish reference, corrupted and remediated; returns the run's summary. Raises Blocked at the gate."""
    config = Config.of(raw_config)
    sinks.empty_target(output)
    for role, path in (("electricity", meter_csv), ("metadata", metadata_csv), ("weather", weather_csv)):
        known = (source_manifest or {}).get(role)
        if known and path:
            try:
                readers.verify_file(path, known.get("size"), known.get("sha256"))
            except ValueError as e:
                sinks.write_blocked(output, "SOURCE_IDENTITY", str(e))
                raise Blocked(str(e)) from e
    got = readers.ingest_selected(spark, meter_csv, metadata_csv, config.selection, config.timestamp_column)
    own: list[DataFrame] = []  # what this run keeps in memory, and frees

    def kept(df: DataFrame) -> DataFrame:
        own.append(df.persist())
        return df

    internal = kept(got["panel"])
    try:
        calibration, quality = frozen(internal, config.quality, kept)
        issues = kept(checked(internal, config, quality, "reference", got["issues"]))
        verdict = Q.gate(issues).first()
        if verdict["status"] == "fail":
            names = ", ".join(r[0] for r in issues.where("status = 'fail'").select("code").orderBy("code").collect())
            sinks.write_blocked(output, "REFERENCE_GATE", f"failed checks: {names}", issues)
            raise Blocked(f"the reference failed: {names}")
        reference = kept(contract(average_duplicates(internal, ["_raw_timestamp"]), "reference"))
        if bad := violations(reference, "reference"):
            raise Blocked("; ".join(bad))
        zone = got["panel"].select("building_id", "timezone").distinct()

        def zoned(df: DataFrame) -> DataFrame:
            return df.join(zone, "building_id", "left")

        validation = FA.inject_structural(reference, cutoff=config.cutoff, seed=config.seed, severity=config.severity, events_per_type=config.events_per_type)
        metrics = FA.confusion(validation.frame, validation.faults, quality)
        suite = FA.inject(reference, cutoff=config.cutoff, seed=config.seed, severity=config.severity, events_per_type=config.events_per_type)
        corrupted = kept(suite.frame)
        done = kept(repair(corrupted, quality, repair_before=config.cutoff, **config.repair))
        remediated = contract(done, "remediated")
        for name, df in (("corrupted", corrupted), ("remediated", remediated)):
            if not verify.key_difference(reference, df).isEmpty():
                raise Blocked(f"{name} has other keys than the reference")
            if not verify.parity(reference, df, config.cutoff, exact=True).isEmpty():
                raise Blocked(f"{name} differs from the reference after the cutoff")
        if not FA.after_cutoff(suite.faults, config.cutoff).isEmpty():
            raise Blocked("a fault lies at or after the cutoff")
        sinks.write_conditions(reference.unionByName(corrupted.select(*reference.columns)).unionByName(remediated), f"{output}/conditions")
        tables = {
            "fault_keys": suite.faults, "fault_events": FA.events(suite.faults), "remediation_log": repair_log(done), "quarantine": quarantine(done),
            "detector_calibration": calibration, "detector_metrics": metrics,
            "issues": mark_seeded(
                Q.issue_log(issues.unionByName(checked(zoned(corrupted), config, quality, "corrupted")).unionByName(checked(zoned(remediated), config, quality, "remediated"))),
                suite.faults,
            ),
        }
        if weather_csv:
            bounds = reference.agg(F.min("timestamp"), F.max("timestamp")).first()
            sites = [r[0] for r in reference.where("site_id IS NOT NULL").select("site_id").distinct().collect()]
            tables["weather"] = W.prepare(readers.weather(spark, weather_csv), sites, str(bounds[0]), str(bounds[1]))
        if raw_config.get("csv_copies"):
            for name in ("reference", "corrupted", "remediated"):
                sinks.write_csv(readers_condition(spark, output, name), f"{output}/csv/{name}", KEYS)
        entries = {}
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{output}/{name}")
            entries[name] = sinks.manifest_entry(spark.read.parquet(f"{output}/{name}"), name)
        for name in ("reference", "corrupted", "remediated"):
            entries[name] = sinks.manifest_entry(readers_condition(spark, output, name), f"conditions/condition={name}")
        statuses = {r[0]: r[1] for r in done.groupBy("status").count().collect()}
        summary = {
            "schema_version": "1.0", "timestamp_semantics": "wall clock, no zone conversion", "cutoff": config.cutoff, "seed": config.seed, "severity": config.severity,
            "buildings": got["buildings"], "exclusions": [list(x) for x in got["exclusions"]], "gate": verdict.asDict(), "repair": statuses, "files": entries,
        }
        summary["repairs_outside_faults"] = verify.footprint(corrupted, remediated, suite.faults).count()
        summary["source_revision"] = reports.source_revision()
        sinks.write_json(f"{output}/dataset_manifest.json", summary)
        sinks.write_text(f"{output}/data_card.md", reports.data_card(summary))
        found = [r.asDict() for r in spark.read.parquet(f"{output}/detector_metrics").orderBy("fault_type").collect()]
        sinks.write_text(f"{output}/report.md", reports.onboarding_report(summary, found))
        return summary
    finally:
        for df in own:
            df.unpersist()


def readers_condition(spark: SparkSession, output: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{output}/conditions").where(F.col("condition") == name).select(*KEYS, "load", "site_id", "primary_use", "condition")


def verify_bundle(spark: SparkSession, output: str) -> list[str]:
    """What is wrong with a published bundle: digests, keys, the cutoff, fault records, the repair's footprint."""
    manifest, out = readers.read_json(f"{output}/dataset_manifest.json"), []
    frames = {n: readers_condition(spark, output, n).persist() for n in ("reference", "corrupted", "remediated")}
    try:
        for name, entry in manifest["files"].items():
            df = frames.get(name)
            df = df if df is not None else spark.read.parquet(f"{output}/{name}")
            if sinks.manifest_entry(df, entry["path"])["content_sha256"] != entry["content_sha256"]:
                out.append(f"{name}: content is not that of the manifest")
        ref, faults = frames["reference"], spark.read.parquet(f"{output}/fault_keys")
        for name in ("corrupted", "remediated"):
            if not verify.key_difference(ref, frames[name]).isEmpty():
                out.append(f"{name}: keys are not those of the reference")
            if not verify.parity(ref, frames[name], manifest["cutoff"]).isEmpty():
                out.append(f"{name}: readings after the cutoff differ")
            if not verify.attribute_difference(ref, frames[name]).isEmpty():
                out.append(f"{name}: metadata differ")
        for what, rows in (
            ("faults without effect or changes without record", verify.documented_changes(ref, frames["corrupted"], faults)),
            ("fault values that are not those of the panels", verify.bind_faults(faults, ref, frames["corrupted"])),
            ("faults at or after the cutoff", FA.after_cutoff(faults, manifest["cutoff"])),
            ("stale fault metadata", FA.stale_metadata(faults)),
            ("repairs that stand in no log", verify.unlogged(frames["corrupted"], frames["remediated"], spark.read.parquet(f"{output}/remediation_log"))),
        ):
            if n := rows.count():
                out.append(f"{what}: {n}")
        changes = verify.footprint(frames["corrupted"], frames["remediated"], faults).count()
        if changes != manifest.get("repairs_outside_faults", changes):
            out.append(f"repairs outside the injected faults: {changes}, not {manifest['repairs_outside_faults']}")
        return out
    finally:
        for df in frames.values():
            df.unpersist()
