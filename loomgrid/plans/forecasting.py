"""Forecast evaluation of a published bundle: fixed day-ahead and direct 1 to 24 hours."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import week_block
from ..operators import bootstrap as B
from ..operators import direct as D
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import models as M
from ..operators import split, verify
from ..schemas import CONDITIONS, FORECAST_KEYS, KEYS
from ..sources import readers, reports, sinks
from .onboarding import readers_condition, verify_bundle


def expected_pairs(models: Sequence[str]) -> set[tuple[str, str]]:
    if unknown := sorted(set(models) - set(M.MODELS)):
        raise ValueError(f"unknown models: {unknown}")
    return {(c, m) for c in CONDITIONS for m in models}


def load_config(path_or_dict: str | dict[str, Any]) -> dict[str, Any]:
    raw = readers.read_json(path_or_dict) if isinstance(path_or_dict, str) else dict(path_or_dict)
    if lost := sorted({"models", "seed", "bootstrap_repetitions"} - set(raw)):
        raise ValueError(f"the configuration lacks {lost}")
    if raw.get("feature_set", "v2") not in ("v2", "v3"):
        raise ValueError("feature_set is 'v2' or 'v3'")
    expected_pairs(raw["models"])
    return raw


def _model_config(raw: dict[str, Any]) -> M.ModelConfig:
    return M.ModelConfig(seed=int(raw["seed"]), **{k: v for k, v in raw.get("model", {}).items() if k in M.ModelConfig.__dataclass_fields__})


def _split(panel: DataFrame, raw: dict[str, Any]) -> split.Split:
    if "train_end" in raw:
        return split.explicit(panel, raw["train_end"], raw["validation_end"])
    return split.by_fractions(panel, raw.get("train_fraction", 0.5), raw.get("validation_fraction", 0.1))


def _training(panel: DataFrame, s: split.Split) -> DataFrame:
    return panel.where(F.col("timestamp") <= F.lit(s.train_end).cast("timestamp_ntz"))


PAIR = ["condition", "model"]
#: Rows of a group that one worker resamples, unless the configuration says otherwise.
GATHER_ROWS = 1_000_000


def _interval(raw: dict[str, Any], rows: DataFrame, value: str, by: Sequence[str], by_index: bool = False) -> DataFrame:
    """Row intervals. ``"bootstrap"`` is "exact" (a group's rows are resampled by one worker), "poisson" (no group
    is gathered) or "auto": exact unless the largest group has more than ``"bootstrap_gather_rows"`` rows."""
    reps, seed = int(raw["bootstrap_repetitions"]), int(raw["seed"])
    form = raw.get("bootstrap", "auto")
    if form == "auto":
        largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        form = "poisson" if largest > int(raw.get("bootstrap_gather_rows", GATHER_ROWS)) else "exact"
    if form == "poisson":
        return B.poisson_bootstrap(rows, value, by, [*KEYS, "model"], reps, seed)
    return B.row_bootstrap(rows, value, by, KEYS, reps, seed, by_index)


def fixed_horizon(frames: dict[str, DataFrame], raw: dict[str, Any], weather: DataFrame | None = None) -> dict[str, DataFrame]:
    """predictions, metrics, entity_mase, macro_mase, subgroups, paired, retained, narrative."""
    config = _model_config(raw)
    s = _split(frames["reference"], raw)
    names = FE.numeric_columns(raw.get("feature_set", "v2"), weather=weather is not None)
    parts = []
    for condition, panel in frames.items():
        df = FE.build(panel, feature_set=raw.get("feature_set", "v2"), weather=weather).persist()
        label = split.label(F.col("timestamp"), s)
        for model in raw["models"]:
            got = M.fit_predict(df.where(label == "train"), df.where(label == "test"), model, config, names)
            parts.append(got.withColumns({"condition": F.lit(condition), "model": F.lit(model)}))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return fixed_tables(E.common_keys(E.attach_targets(long, frames["reference"]), len(parts)).persist(), frames, raw)


def fixed_tables(long: DataFrame, frames: dict[str, DataFrame], raw: dict[str, Any]) -> dict[str, DataFrame]:
    """Every table of a fixed-horizon run, from its predictions, the conditions and the configuration."""
    s = _split(frames["reference"], raw)
    train = _training(frames["reference"], s)
    scale = E.pooled_scale(train).first()[0]
    errors = long.withColumn("error", F.abs(F.col("prediction") - F.col("target")))
    groups = [*PAIR, "group_dimension", "group_value"]
    metrics = E.metrics(long, scale).join(_interval(raw, errors, "error", PAIR), PAIR)
    conditions = None
    for c, f in frames.items():
        f = f.select(*KEYS, "load").withColumn("condition", F.lit(c))
        conditions = f if conditions is None else conditions.unionByName(f)
    retained = E.data_retained(conditions, s.train_end)
    paired = E.paired_rows(long)
    entity = E.entity_mase(long, E.entity_scales(train))
    return {
        "predictions": long, "metrics": metrics.join(retained, "condition"), "entity_mase": entity, "macro_mase": E.macro_mase(entity),
        "subgroups": E.subgroup_metrics(long, scale).join(_interval(raw, E.by_subgroup(errors), "error", groups), groups),
        "paired": E.paired_difference(paired).join(_interval(raw, paired, "difference", ["model"], by_index=True), "model"),
        "narrative": E.narrative(metrics),
    }


def direct_horizons(frames: dict[str, DataFrame], raw: dict[str, Any], weather: DataFrame | None = None) -> dict[str, DataFrame]:
    """predictions, metrics, horizons, paired, paired_horizons with block intervals."""
    config, s = _model_config(raw), _split(frames["reference"], raw)
    numeric = D.NUMERIC + (D.WEATHER if weather is not None else [])
    keys = [*FORECAST_KEYS, "site_id", "primary_use"]
    parts = []
    for condition, panel in frames.items():
        rows = D.origin_partitions(D.examples(panel, origin_hour=int(raw.get("origin_hour", 23)), weather=weather), s)
        rows = rows.withColumnsRenamed({"direct_lag_168": "lag_168", "direct_lag_24": "lag_24"}).persist()
        own = ["lag_168" if c == "direct_lag_168" else "lag_24" if c == "direct_lag_24" else c for c in numeric]
        for model in raw["models"]:
            got = M.fit_predict(rows.where("partition = 'train'"), rows.where("partition = 'test'"), model, config, own, target="condition_target", keys=keys)
            parts.append(got.withColumns({"condition": F.lit(condition), "model": F.lit(model)}))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    truth = frames["reference"].select(F.col("timestamp").alias("target_timestamp"), "building_id", "load")
    long = E.attach_targets(long, truth, ["target_timestamp", "building_id"])
    long = E.complete_vectors(long, len(parts)).withColumn("block", week_block(F.col("building_id"), F.col("forecast_origin"))).persist()
    return direct_tables(long, frames["reference"], raw)


def direct_tables(long: DataFrame, reference: DataFrame, raw: dict[str, Any]) -> dict[str, DataFrame]:
    """Every table of a direct run, from its predictions, the reference and the configuration."""
    s = _split(reference, raw)
    scale = E.pooled_scale(_training(reference, s)).first()[0]
    reps, seed = int(raw["bootstrap_repetitions"]), int(raw["seed"])
    errors = long.withColumn("error", F.abs(F.col("prediction") - F.col("target")))
    by, by_h = ["condition", "model"], ["condition", "model", "horizon_hours"]
    paired = E.paired_rows(long, FORECAST_KEYS).withColumn("block", week_block(F.col("building_id"), F.col("forecast_origin")))
    return {
        "predictions": long,
        "metrics": E.metrics(long, scale).join(B.block_bootstrap(errors, "error", "block", by, reps, seed), by),
        "horizons": E.metrics(long, scale, by_h).join(B.block_bootstrap(errors, "error", "block", by_h, reps, seed, "horizon_hours"), by_h),
        "paired": E.paired_difference(paired).join(B.block_bootstrap(paired, "difference", "block", ["model"], reps, seed), "model"),
        "paired_horizons": E.paired_difference(paired, ["model", "horizon_hours"]).join(
            B.block_bootstrap(paired, "difference", "block", ["model", "horizon_hours"], reps, seed, "horizon_hours"), ["model", "horizon_hours"]
        ),
    }


def run(spark: SparkSession, bundle: str, config: str | dict[str, Any], output: str, direct: bool = False) -> dict[str, Any]:
    """Verify the bundle, evaluate, publish the tables, verify what was published."""
    raw = load_config(config)
    if bad := verify_bundle(spark, bundle):
        raise ValueError(f"the bundle does not verify: {bad}")
    manifest = readers.read_json(f"{bundle}/dataset_manifest.json")
    frames = {c: readers_condition(spark, bundle, c) for c in CONDITIONS}
    if direct:
        D.assert_cutoff(manifest["cutoff"], _split(frames["reference"], raw).train_end)
    weather = spark.read.parquet(f"{bundle}/weather") if raw.get("weather") and "weather" in manifest["files"] else None
    sinks.empty_target(output)
    tables = (direct_horizons if direct else fixed_horizon)(frames, raw, weather)
    entries = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{output}/{name}")
        entries[name] = sinks.manifest_entry(spark.read.parquet(f"{output}/{name}"), name)
    result = {"schema_version": "1.0", "models": sorted(raw["models"]), "direct": direct, "config": raw, "source_digest": manifest["files"]["reference"]["content_sha256"], "files": entries}
    result["source_revision"] = reports.source_revision()
    sinks.write_json(f"{output}/run_manifest.json", result)
    small = {n: [r.asDict() for r in spark.read.parquet(f"{output}/{n}").collect()] for n in ("metrics", "paired", "narrative", "horizons") if n in tables}
    sinks.write_text(f"{output}/report.md", reports.forecast_report(small))
    sinks.write_text(f"{output}/mae.svg", reports.bars(small["metrics"], "mae", "Mean absolute error"))
    sinks.write_text(f"{output}/mase.svg", reports.bars(small["metrics"], "mase", "Scaled error"))
    if "horizons" in small:
        sinks.write_text(f"{output}/horizons.svg", reports.lines(small["horizons"], "horizon_hours", "mae", "Error by horizon"))
    if raw.get("csv_copies"):
        sinks.write_csv(spark.read.parquet(f"{output}/predictions"), f"{output}/csv/predictions", FORECAST_KEYS if direct else KEYS)
    tables["predictions"].unpersist()
    if bad := verify_results(spark, output, bundle):
        raise ValueError(f"the result does not verify: {bad}")
    return result


#: What the rows of each published table stand for.
TABLE_KEYS = {
    "metrics": PAIR, "entity_mase": [*PAIR, "building_id"], "macro_mase": PAIR, "subgroups": [*PAIR, "group_dimension", "group_value"],
    "paired": ["model"], "narrative": ["model"], "horizons": [*PAIR, "horizon_hours"], "paired_horizons": ["model", "horizon_hours"],
}


def verify_results(spark: SparkSession, output: str, bundle: str | None = None) -> list[str]:
    """What is wrong with a published run.

    Digests, the prediction contract, and plain metrics and paired differences
    from the predictions. With the bundle also its digest, targets and the
    partition bound to the source, and every published table recomputed in
    full: scales, MASE, intervals, entities, subgroups, shares, horizons.
    """
    manifest, out = readers.read_json(f"{output}/run_manifest.json"), []
    tables = {n: spark.read.parquet(f"{output}/{n}") for n in manifest["files"]}
    for name, entry in manifest["files"].items():
        if sinks.manifest_entry(tables[name], name)["content_sha256"] != entry["content_sha256"]:
            out.append(f"{name}: content is not that of the manifest")
    pairs, predictions, direct = expected_pairs(manifest["models"]), tables["predictions"], manifest["direct"]
    found = {tuple(r) for r in predictions.select("condition", "model").distinct().collect()}
    if found != pairs:
        out.append("predictions do not have the expected conditions and models")
    keys = FORECAST_KEYS if direct else KEYS
    if not verify.prediction_contract(predictions, len(pairs), keys).isEmpty():
        out.append("keys without a prediction from every pair, or with several targets")
    if direct and not verify.incomplete_vectors(predictions).isEmpty():
        out.append("incomplete horizon vectors")
    again = {"metrics": E.metrics(predictions, None).drop("mase"), "paired": E.paired_difference(E.paired_rows(predictions, keys))}
    if bundle:
        source, raw = readers.read_json(f"{bundle}/dataset_manifest.json"), manifest["config"]
        if source["files"]["reference"]["content_sha256"] != manifest["source_digest"]:
            out.append("the run is of another bundle")
        frames = {c: readers_condition(spark, bundle, c) for c in CONDITIONS}
        at = "target_timestamp" if direct else "timestamp"
        ref = frames["reference"].withColumnRenamed("timestamp", at)
        if not verify.unbound_predictions(predictions, ref, [at, "building_id"]).isEmpty():
            out.append("targets are not the reference readings")
        s, first = _split(frames["reference"], raw), F.col("forecast_origin" if direct else "timestamp")
        if not predictions.where(first <= F.lit(s.train_end).cast("timestamp_ntz")).isEmpty():
            out.append("predictions inside the training span")
        again = direct_tables(predictions, frames["reference"], raw) if direct else fixed_tables(predictions, frames, raw)
        if lost := sorted(set(again) - set(tables)):
            out.append(f"tables that are not there: {lost}")
    for name, expected in again.items():
        if name == "predictions" or name not in tables:
            continue
        if lost := sorted(set(expected.columns) - set(tables[name].columns)):
            out.append(f"{name}: columns that are not there: {lost}")
        elif not verify.table_difference(tables[name].select(*expected.columns), expected, TABLE_KEYS[name]).isEmpty():
            out.append(f"{name}: does not follow from the predictions and the source")
    return out
