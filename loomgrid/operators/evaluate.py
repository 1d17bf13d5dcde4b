"""Forecast evaluation: alignment, error metrics, scales, paired differences.

Metrics are one grouped aggregation over long predictions (keys, condition,
model, prediction, target); groupings by condition, model, subgroup or horizon
differ only in their keys, and subgroups share one pass by grouping sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null, is_finite, quarter_label, ratio
from ..schemas import FORECAST_KEYS, KEYS
from .direct import HORIZONS
from .windows import ordered


def attach_targets(predictions: DataFrame, reference: DataFrame, on: Sequence[str] = KEYS, target: str = "load") -> DataFrame:
    """Inner join with the reference readings; pairs that are not finite leave."""
    truth = reference.select(*on, F.col(target).alias("target"))
    return predictions.join(truth, list(on)).where(is_finite(F.col("prediction")) & is_finite(F.col("target")))


def common_keys(predictions: DataFrame, pairs: int, on: Sequence[str] = KEYS) -> DataFrame:
    """Rows whose key has a prediction from every condition and model."""
    whole = Window.partitionBy(*on)
    return predictions.withColumn("n__", F.count(F.lit(1)).over(whole)).where(F.col("n__") == pairs).drop("n__")


def duplicate_predictions(predictions: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    return predictions.groupBy(*on, "condition", "model").count().where("count > 1")


def complete_vectors(predictions: DataFrame, pairs: int) -> DataFrame:
    """Common forecast keys, then only origins and entities with all horizons."""
    aligned = common_keys(predictions, pairs, FORECAST_KEYS)
    whole = Window.partitionBy("forecast_origin", "building_id")
    size = F.size(F.collect_set("horizon_hours").over(whole))
    return aligned.withColumn("h__", size).where(F.col("h__") == HORIZONS).drop("h__")


def seasonal_differences(train: DataFrame, period: int = 168) -> DataFrame:
    """building_id, difference: absolute change against the row a period before."""
    before = F.lag("load", period).over(ordered("building_id"))
    return train.select("building_id", finite_or_null(F.abs(F.col("load") - before)).alias("difference"))


def pooled_scale(train: DataFrame, period: int = 168) -> DataFrame:
    """One row: scale, null where there is no change to measure."""
    return seasonal_differences(train, period).agg(F.nullif(F.avg("difference"), F.lit(0.0)).alias("scale"))


def entity_scales(train: DataFrame, period: int = 168) -> DataFrame:
    """building_id, scale for every entity; null where undefined."""
    return seasonal_differences(train, period).groupBy("building_id").agg(F.nullif(F.avg("difference"), F.lit(0.0)).alias("scale"))


def scale_coverage(scales: DataFrame) -> DataFrame:
    known = is_finite(F.col("scale")) & (F.col("scale") > 0)
    return scales.agg(
        F.count(F.lit(1)).alias("building_count"), F.count_if(known).alias("valid_scale_count"), F.count_if(~known).alias("undefined_scale_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(known, F.col("building_id")))), ";").alias("valid_scale_buildings"),
        F.array_join(F.array_sort(F.collect_list(F.when(~known, F.col("building_id")))), ";").alias("undefined_scale_buildings"),
    )


def metric_columns(scale: Column | float | None) -> list[Column]:
    """n, mae, rmse, wmape, mase, r2 over finite pairs."""
    y, p = F.col("target"), F.col("prediction")
    ok = is_finite(y) & is_finite(p)
    e = F.when(ok, p - y)
    own = F.when(ok, y)
    n = F.count(e)
    scale = F.lit(scale).cast("double") if not isinstance(scale, Column) else scale
    spread = F.var_pop(own) * n
    return [
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        ratio(F.sum(F.abs(e)), F.sum(F.abs(own))).alias("wmape"),
        (F.avg(F.abs(e)) / F.when(scale > 0, scale)).alias("mase"),
        F.when(n >= 2, 1 - ratio(F.sum(e * e), spread)).alias("r2"),
    ]


def metrics(predictions: DataFrame, scale: float | None, by: Sequence[str] = ("condition", "model")) -> DataFrame:
    return predictions.groupBy(*by).agg(*metric_columns(scale))


def subgroup_metrics(predictions: DataFrame, scale: float | None) -> DataFrame:
    """Metrics by site, use, entity and quarter beside condition and model."""
    dims = ["site_id", "primary_use", "building_id", "quarter"]
    df = predictions.withColumn("quarter", quarter_label(F.col("timestamp")))
    sets = [["condition", "model", d] for d in dims]
    got = df.groupingSets(sets, "condition", "model", *dims).agg(*metric_columns(scale), F.grouping_id().alias("gid"))
    # four low bits: 1 where the dimension is not part of the set
    names = [F.when(F.col("gid").bitwiseAND(15) == 15 - (8 >> i), d) for i, d in enumerate(dims)]
    return got.select(
        "condition", "model", F.coalesce(*names).alias("group_dimension"), F.coalesce(*[F.col(d) for d in dims]).alias("group_value"),
        "n", "mae", "rmse", "wmape", "mase", "r2",
    )


def by_subgroup(rows: DataFrame) -> DataFrame:
    """Each row once for its site, use, entity and quarter, as group_dimension and group_value."""
    values = {"site_id": F.col("site_id"), "primary_use": F.col("primary_use"), "building_id": F.col("building_id"), "quarter": quarter_label(F.col("timestamp"))}
    return rows.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("group_dimension"), v.alias("group_value")) for k, v in values.items()])))


def entity_mase(predictions: DataFrame, scales: DataFrame, by: Sequence[str] = ("condition", "model")) -> DataFrame:
    """Per entity: n, mae, its training scale and mase; undefined ones stay as null."""
    ok = is_finite(F.col("target")) & is_finite(F.col("prediction"))
    e = F.when(ok, F.abs(F.col("prediction") - F.col("target")))
    per = predictions.groupBy(*by, "building_id").agg(F.count(e).alias("n"), F.avg(e).alias("mae"))
    out = per.join(scales.select("building_id", F.col("scale").alias("reference_training_scale")), "building_id", "left")
    return out.withColumn("mase", F.col("mae") / F.when(F.col("reference_training_scale") > 0, F.col("reference_training_scale")))


def macro_mase(per_entity: DataFrame, by: Sequence[str] = ("condition", "model")) -> DataFrame:
    return per_entity.groupBy(*by).agg(
        F.avg("mase").alias("macro_mase"), F.count("mase").alias("buildings_evaluated"),
        (F.count(F.lit(1)) - F.count("mase")).alias("buildings_undefined"),
    )


def paired_rows(predictions: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    """One row per key and model with the corrupted and the remediated absolute error.

    Both conditions meet by conditional aggregation on the key, one exchange.
    """
    pick = lambda c, v: F.max(F.when(F.col("condition") == c, F.col(v)))
    wide = predictions.where(F.col("condition").isin("corrupted", "remediated")).groupBy(*on, "model").agg(
        pick("corrupted", "prediction").alias("pc"), pick("remediated", "prediction").alias("pr"),
        pick("corrupted", "target").alias("tc"), pick("remediated", "target").alias("tr"),
    )
    wide = wide.where(" AND ".join(f"{c} IS NOT NULL" for c in ("pc", "pr", "tc", "tr")))
    return wide.select(
        *on, "model", F.abs(F.col("pc") - F.col("tc")).alias("corrupted_error"), F.abs(F.col("pr") - F.col("tr")).alias("remediated_error"),
        (~F.col("tc").eqNullSafe(F.col("tr"))).alias("targets_differ"),
    ).withColumn("difference", F.col("remediated_error") - F.col("corrupted_error"))


def paired_difference(paired: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Remediated minus corrupted mean absolute error; negative favours repair."""
    return paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("corrupted_error").alias("corrupted_mae"), F.avg("remediated_error").alias("remediated_mae"),
        F.avg("difference").alias("mean_difference"), F.count_if("targets_differ").alias("targets_differ"),
    )


def data_retained(conditions: DataFrame, train_end: str) -> DataFrame:
    """Non-null training readings of a condition over all reference training rows."""
    train = conditions.where(F.col("timestamp") <= F.lit(train_end).cast("timestamp_ntz"))
    all_rows = train.where("condition = 'reference'").groupBy().agg(F.count(F.lit(1))).scalar()
    return train.groupBy("condition").agg(F.count("load").alias("training_rows")).withColumn("data_retained", F.try_divide(F.col("training_rows"), all_rows))


def narrative(metric_table: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Relative effects of corruption and repair, skill over the naive model, and the kind of recovery."""
    pick = lambda c: F.max(F.when(F.col("condition") == c, F.col("mase")))
    wide = metric_table.groupBy("model").agg(pick("reference").alias("r"), pick("corrupted").alias("c"), pick("remediated").alias("m"))
    naive = wide.where("model = 'seasonal_naive'").select("r").scalar()
    gap = (F.col("m") - F.col("r")) / F.col("r")
    return wide.select(
        "model", ratio(F.col("c") - F.col("r"), F.col("r")).alias("corruption_effect"),
        ratio(F.col("m") - F.col("c"), F.col("c")).alias("repair_effect"), (1 - ratio(F.col("r"), naive)).alias("skill"),
        F.when(gap < -tolerance, "better_than_reference").when(gap <= tolerance, "full").when(F.col("m") < F.col("c"), "partial").otherwise("none").alias("recovery"),
    )
