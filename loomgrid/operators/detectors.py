"""Causal anomaly masks and the calibration of the stuck-sensor rule.

One plan for all masks: rows are hashed by entity once, into as many tasks as
their number asks, every window below is keyed by the entity (or by the entity
and a run), so Spark needs no further exchange. Readings without a timestamp sort last, where no causal frame sees
them, and are flagged only by what their value alone shows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import INF, finite_or_null, flag, hour_of_week, no_nan
from .windows import by_entity, median, ordered, rolling, run_id, run_length, run_position, running

MASKS = ("missing", "infinite", "negative", "outlier", "long_zero", "stuck", "level_shift")


# The defaults of the configuration.
@dataclass(frozen=True)
class QualityConfig:
    frequency_hours: int = 1
    long_zero_threshold: int = 6
    stuck_threshold: int = 8
    outlier_mad_z: float = 12.0
    level_shift_ratio: float = 8.0
    causal_window: int = 168
    rare_group_fraction: float = 0.01
    run_flagging: str = "tail"
    stuck_calibration_quantile: float | None = None
    zero_profile_min_ratio: float | None = None
    profile_weeks: int = 8
    calibration_end: str | None = None
    #: Frozen thresholds by entity (a table of building_id, stuck_threshold for many); they replace the quantile of the inspected rows.
    stuck_thresholds_by_building: Mapping[str, int] | DataFrame | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.run_flagging not in ("tail", "whole_run"):
            raise ValueError("run_flagging is 'tail' or 'whole_run'")
        if self.stuck_calibration_quantile is not None and not 0 < self.stuck_calibration_quantile <= 1:
            raise ValueError("stuck_calibration_quantile lies in (0, 1]")
        if self.zero_profile_min_ratio is not None and self.zero_profile_min_ratio < 0:
            raise ValueError("zero_profile_min_ratio is not negative")
        if self.profile_weeks < 1:
            raise ValueError("profile_weeks is at least 1")


def hour_of_week_profile(load: Column, weeks: int) -> Column:
    """Median of the previous ``weeks`` rows of the same entity and hour of the week, two at least."""
    slot = Window.partitionBy("building_id", hour_of_week(F.col("timestamp"))).orderBy(F.col("timestamp").asc_nulls_last())
    return median(load, slot.rowsBetween(-weeks, -1), 2)


def _shifted(load: Column, level: Column, factor: float) -> Column:
    return (level > 0) & ((load > level * factor) | (load < level / factor))


def annotate(panel: DataFrame, config: QualityConfig, tasks: int | None = None) -> DataFrame:
    """The panel with ``is_<mask>`` for all masks and the run columns the calibration reads.

    The panel is counted for the number of its tasks, unless that is given.
    """
    w = ordered("building_id")
    key, ts, x = F.col("building_id"), F.col("timestamp"), F.col("x")
    dated = ts.isNotNull()
    least = min(6, max(1, config.causal_window))
    boundary = F.lit(config.calibration_end).cast("timestamp_ntz") if config.calibration_end else None
    in_calibration = dated & (flag(ts < boundary) if boundary is not None else F.lit(True))

    df = by_entity(panel, tasks).withColumn("x", no_nan(F.col("load").cast("double")))
    df = df.withColumns({"prior": F.lag("x", 1).over(w), "row__": F.row_number().over(w)})
    prior_finite = finite_or_null(F.col("prior"))
    df = df.withColumns(
        {
            "median": rolling(prior_finite, "median", config.causal_window, least, w),
            "level": rolling(prior_finite, "median", 24, 6, w),
            "is_zero": dated & flag(x == 0),
            "repeats": dated & flag(x == F.col("prior")) & flag(x != 0),
            "changes": ~dated | x.isNull() | ~flag(x == F.col("prior")),
            "calibrating": in_calibration,
        }
    )
    deviation = finite_or_null(F.abs(F.col("prior") - F.col("median")))
    df = df.withColumns(
        {
            "deviation": deviation,
            "constant_run": running(F.col("changes"), w),
            "zero_run": run_id(F.col("is_zero"), w),
        }
    )
    run = Window.partitionBy("building_id", "constant_run")
    whole = Window.partitionBy("building_id")
    df = df.withColumns(
        {
            "mad": rolling(F.col("deviation"), "median", config.causal_window, least, w),
            "run_rows": F.count(F.lit(1)).over(run),
            "zero_length": run_length(F.col("is_zero"), key, F.col("zero_run")),
            "zero_position": run_position(F.col("is_zero"), F.col("row__"), w),
            "repeat_position": run_position(F.col("repeats"), F.col("row__"), w),
        }
    )
    df = df.withColumn("stuck_member", dated & x.isNotNull() & flag(x != 0) & (F.col("run_rows") >= 2))
    natural = F.col("stuck_member") & F.col("calibrating")
    df = df.withColumn("natural_length", F.sum(natural.cast("int")).over(run))
    counted = F.col("changes") & natural & (F.col("natural_length") >= 2)
    df = df.withColumn("natural_run", F.when(counted, F.col("natural_length")))

    threshold, quantile, source = F.lit(config.stuck_threshold), F.lit(None).cast("double"), F.lit("configured")
    if config.stuck_calibration_quantile is not None:
        quantile = F.percentile("natural_run", F.lit(float(config.stuck_calibration_quantile))).over(whole)
        measured = F.greatest(threshold, F.ceil(quantile).cast("int") + 1)
        source = F.when(quantile.isNotNull(), "quantile_on_inspected_frame").otherwise(source)
        threshold = F.when(quantile.isNotNull(), measured).otherwise(threshold)
    if config.stuck_thresholds_by_building is not None:
        frozen = config.stuck_thresholds_by_building
        if not isinstance(frozen, DataFrame):
            frozen = panel.sparkSession.createDataFrame([(str(k), int(n)) for k, n in frozen.items()], "building_id string, stuck_threshold int")
        df = df.join(frozen.select("building_id", F.col("stuck_threshold").alias("stuck_frozen")), "building_id", "left")
        fixed = F.col("stuck_frozen")
        threshold = F.when(fixed.isNotNull(), F.greatest(F.lit(config.stuck_threshold), fixed)).otherwise(threshold)
        source = F.when(fixed.isNotNull(), "reference_calibration").otherwise(source)
    df = df.withColumns({"run_quantile": quantile, "stuck_effective": threshold, "calibration_source": source})

    if config.run_flagging == "whole_run":
        stuck = F.col("stuck_member") & (F.col("run_rows") >= F.col("stuck_effective"))
        long_zero = F.col("is_zero") & (F.col("zero_length") >= config.long_zero_threshold)
    else:
        stuck = F.col("repeats") & (F.col("repeat_position") + 1 >= F.col("stuck_effective"))
        long_zero = F.col("is_zero") & (F.col("zero_position") >= config.long_zero_threshold)
    exempted = F.lit(False)
    if config.zero_profile_min_ratio is not None:
        df = df.withColumn("profile", hour_of_week_profile(finite_or_null(x), config.profile_weeks))
        usual = F.col("profile") > F.lit(float(config.zero_profile_min_ratio)) * F.col("median")
        vote = F.col("is_zero") & (F.col("profile").isNull() | F.col("median").isNull() | flag(usual))
        df = df.withColumn("run_votes", F.max(vote).over(Window.partitionBy("building_id", "zero_run")))
        long_zero = long_zero & F.col("run_votes")
        exempted = F.col("is_zero") & (F.col("zero_length") >= config.long_zero_threshold) & ~flag(long_zero)
    z = F.abs(x - F.col("median")) / (F.lit(1.4826) * F.nullif(F.col("mad"), F.lit(0.0)))
    outlier = flag(z > config.outlier_mad_z) | flag(_shifted(x, F.col("median"), config.level_shift_ratio))
    return df.withColumns(
        {
            "is_missing": x.isNull(),
            "is_infinite": flag(F.abs(x) == F.lit(INF)),
            "is_negative": flag(x < 0),
            "is_outlier": dated & outlier,
            "is_long_zero": flag(long_zero),
            "is_stuck": flag(stuck),
            "is_level_shift": dated & flag(_shifted(x, F.col("level"), config.level_shift_ratio)),
            "zero_exempted": exempted,
        }
    )


def anomaly_masks(panel: DataFrame, config: QualityConfig | None = None, tasks: int | None = None) -> DataFrame:
    """All columns of the panel and the seven masks."""
    return annotate(panel, config or QualityConfig(), tasks).select(*panel.columns, *[f"is_{m}" for m in MASKS])


def calibration_table(panel: DataFrame, config: QualityConfig) -> DataFrame:
    """One row for each entity: what its natural runs look like and the threshold that follows."""
    df = annotate(panel, config).where("timestamp IS NOT NULL")
    cal = F.col("calibrating")
    quantile_on = config.stuck_calibration_quantile is not None
    return df.groupBy(F.coalesce("building_id", F.lit("<missing>")).alias("building_id")).agg(
        F.count_if(cal).alias("calibration_rows"),
        F.avg(F.when(cal, F.col("repeats").cast("int"))).alias("repeat_rate"),
        F.avg(F.when(cal, F.col("is_zero").cast("int"))).alias("zero_rate"),
        (F.count("natural_run") if quantile_on else F.lit(0).cast("long")).alias("constant_run_count"),
        F.max("run_quantile").alias("constant_run_length_quantile"),
        F.lit(config.stuck_threshold).alias("stuck_threshold_configured"),
        F.max("stuck_effective").alias("stuck_threshold_effective"),
        F.max("calibration_source").alias("calibration_source"),
        F.lit(config.long_zero_threshold).alias("long_zero_threshold"),
        F.lit(config.zero_profile_min_ratio).cast("double").alias("zero_profile_min_ratio"),
        F.lit(config.profile_weeks).alias("profile_weeks"),
        F.lit(config.run_flagging).alias("run_flagging"),
        F.count_if("zero_exempted").alias("zero_rows_exempted_by_profile"),
    )
