"""Past-only repair and quarantine as one windowed plan.

The state a sequential repair would carry (last valid reading, position in the
bad run, history of the hour of the week) is three window expressions on the
entity key: the last valid reading before the row, a running count of bad rows
less what it was at the last reset, and the median of the last valid readings of
the slot, found by a range frame over an ordinal that only valid readings advance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flag, hour_of_week, is_finite
from .detectors import QualityConfig, annotate
from .windows import BEGIN, median, running, since

STRATEGIES = ("forward_fill", "forward_then_profile")
# Reason names in the order they are joined.
REASONS = (
    ("is_missing", "missing_load"),
    ("is_infinite", "infinite_load"),
    ("is_negative", "negative_load"),
    ("is_outlier", "robust_outlier"),
    ("is_long_zero", "long_zero_run"),
    ("is_stuck", "stuck_sensor"),
    ("ambiguous", "ambiguous_level_or_unit_shift"),
    ("bad_metadata", "missing_metadata"),
    ("bad_timestamp", "invalid_timestamp"),
)


def repair(
    panel: DataFrame,
    config: QualityConfig | None = None,
    *,
    forward_hours: int = 3,
    repair_before: str | None = None,
    strategy: str = "forward_fill",
    profile_hours: int = 48,
    profile_weeks: int = 8,
    profile_fills_ambiguous: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """The panel with original_value, load (repaired), status, rule and reason.

    status is valid, protected, repaired or quarantined; the last two are the
    log. Only readings before ``repair_before`` are repaired; later ones (and,
    with a boundary, rows without a timestamp) are protected, but their values
    count as last valid readings.
    """
    if forward_hours < 0 or profile_hours < 0:
        raise ValueError("limits are not negative")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    if profile_weeks < 1:
        raise ValueError("profile_weeks is at least 1")
    config = config or QualityConfig()
    columns = panel.columns
    ts = F.col("timestamp")
    protected = ~flag(ts < F.lit(repair_before).cast("timestamp_ntz")) if repair_before else F.lit(False)
    df = annotate(panel, config, tasks).withColumn("protected", protected)
    open_ = ~F.col("protected")
    df = df.withColumns(
        {
            "ambiguous": F.col("is_level_shift") & open_,
            "bad_metadata": (F.col("site_id").isNull() | F.col("primary_use").isNull()) & open_,
            "bad_timestamp": ts.isNull() & open_,
            "bad_value": open_
            & (
                F.col("is_missing") | F.col("is_infinite") | F.col("is_negative") | F.col("is_outlier")
                | F.col("is_long_zero") | F.col("is_stuck") | F.col("is_level_shift")
            ),
            "slot": hour_of_week(ts),
        }
    )
    df = df.withColumn("structural", F.col("bad_metadata") | F.col("bad_timestamp"))
    df = df.withColumn("value", F.when(~F.col("bad_value"), F.col("x")))
    df = df.withColumn("valid", open_ & ~F.col("bad_value") & ~F.col("structural") & is_finite(F.col("value")))
    df = df.withColumn("resets", F.col("valid") | (F.col("protected") & is_finite(F.col("value"))))
    # rows without a timestamp come first here, as the repair meets them first
    time = ts.asc_nulls_first()
    entity = Window.partitionBy("building_id").orderBy(time)
    slot = Window.partitionBy("building_id", "slot").orderBy(time)
    df = df.withColumns(
        {
            "last_valid": F.last(F.when(F.col("resets"), F.col("value")), ignorenulls=True).over(entity.rowsBetween(BEGIN, -1)),
            "bad_rows__": running(open_ & ~F.col("valid"), entity),
        }
    )
    # both windows of the entity before those of the slot: one sort serves them
    df = df.withColumn("position", F.col("bad_rows__") - since(F.col("resets"), F.col("bad_rows__"), entity))
    df = df.withColumn("ordinal", F.coalesce(F.sum(F.col("valid").cast("int")).over(slot.rowsBetween(BEGIN, -1)), F.lit(0)))
    history = Window.partitionBy("building_id", "slot").orderBy("ordinal").rangeBetween(-profile_weeks, -1)
    past = F.when(F.col("valid"), F.col("value"))
    df = df.withColumns(
        {
            "history_median": median(past, history, 1),
            "history_rows": F.count(past).over(history),
        }
    )
    repairable = F.col("bad_value") & ~F.col("structural")
    zero_from_zero = F.col("is_long_zero") & flag(F.col("last_valid") == 0)
    forward = repairable & ~F.col("ambiguous") & ~zero_from_zero & F.col("last_valid").isNotNull() & (F.col("position") <= forward_hours)
    may_profile = F.lit(True) if profile_fills_ambiguous else ~F.col("ambiguous")
    by_profile = (
        F.lit(strategy == "forward_then_profile") & repairable & may_profile
        & (F.col("position") <= profile_hours) & F.col("slot").isNotNull() & (F.col("history_rows") >= 2)
    )
    df = df.withColumns(
        {
            "action": F.when(F.col("protected"), "protected").when(F.col("valid"), "valid")
            .when(flag(forward), "forward").when(flag(by_profile), "profile").otherwise("quarantined"),
            "reason": F.coalesce(
                F.nullif(F.concat_ws(";", *[F.when(F.col(c), name) for c, name in REASONS]), F.lit("")),
                F.lit("unresolved_quality_issue"),
            ),
        }
    )
    rule = (
        F.when(F.col("action") == "forward", f"past_only_forward_fill_limit_{forward_hours}h")
        .when(F.col("action") == "profile", f"past_only_hour_of_week_median_{profile_weeks}w_limit_{profile_hours}h")
        .when(F.col("action") == "quarantined", "preserve_key_with_null")
    )
    load = (
        F.when(F.col("action").isin("protected", "valid"), F.col("value"))
        .when(F.col("action") == "forward", F.col("last_valid"))
        .when(F.col("action") == "profile", F.col("history_median"))
    )
    kept = [c for c in columns if c not in ("load", "condition")]
    acted = F.col("action").isin("forward", "profile", "quarantined")
    return df.select(
        *kept,
        load.alias("load"),
        F.lit("remediated").alias("condition"),
        F.col("x").alias("original_value"),
        F.when(F.col("action").isin("forward", "profile"), "repaired").otherwise(F.col("action")).alias("status"),
        rule.alias("rule"),
        F.when(acted, F.col("reason")).alias("reason"),
    )


def repair_log(repaired: DataFrame) -> DataFrame:
    return repaired.where(F.col("status").isin("repaired", "quarantined")).select(
        "timestamp", "building_id", "original_value", F.col("load").alias("remediated_value"), "rule", "status", "reason"
    )


def quarantine(repaired: DataFrame) -> DataFrame:
    return repaired.where("status = 'quarantined'").select(
        "timestamp", "building_id", F.col("original_value").alias("load"), "site_id", "primary_use", "condition", "reason"
    )
