"""Queries on features, forecasts and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import week_block
from ..operators import bootstrap as B
from ..operators import direct as D
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import models as M
from ..operators import split
from .inputs import (
    CORRUPTED, CUTOFF, GRID, PANEL, TRAIN_END, VALIDATION_END, WEATHER, corrupted_panel, value_panel, weather,
)
from ..operators import weather as W

QUERIES, ORACLES = {}, {}
SPLIT = split.Split(TRAIN_END, VALIDATION_END, "2024-01-30 23:00:00")
_KEY = ("timestamp", "building_id")
_LAST = "TIMESTAMP '2024-01-30 23:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Means of a few cent values can end in an exact half; both sides round a hair above it.
_HAIR = 3e-9


def _round(c, n=6):
    return (F.round(F.col(c) + F.lit(_HAIR if n == 6 else 0.0), n) + F.lit(0.0)).alias(c)


def _rounded(df, columns, n=6):
    return df.select(*_KEY, *[_round(c, n) for c in columns])


@query(f"WITH {PANEL} SELECT timestamp, building_id, lag(load, 24) OVER w AS lag_24, lag(load, 48) OVER w AS lag_48, lag(load, 168) OVER w AS lag_168, lag(load, 336) OVER w AS lag_336 FROM panel WINDOW w AS (PARTITION BY building_id ORDER BY timestamp)")
def lag_features(spark, d):
    return FE.lags(value_panel(spark, d), (24, 48, 168, 336)).select(*_KEY, "lag_24", "lag_48", "lag_168", "lag_336")


def _roll(col, f, n, a, b):
    fn = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}[f]
    frame = f"(PARTITION BY building_id ORDER BY timestamp ROWS BETWEEN {a} PRECEDING AND {b})"
    return f"CASE WHEN count({col}) OVER {frame} >= {n} THEN round({fn}({col}) OVER {frame} + {_HAIR}, 6) END"


@query(f"""WITH {PANEL} SELECT timestamp, building_id, {_roll('load', 'mean', 6, 47, '24 PRECEDING')} AS rolling_mean_24, {_roll('load', 'std', 6, 47, '24 PRECEDING')} AS rolling_std_24,
 {_roll('load', 'min', 6, 47, '24 PRECEDING')} AS rolling_min_24, {_roll('load', 'max', 6, 47, '24 PRECEDING')} AS rolling_max_24,
 {_roll('load', 'mean', 42, 191, '24 PRECEDING')} AS rolling_mean_168, {_roll('load', 'std', 42, 191, '24 PRECEDING')} AS rolling_std_168 FROM panel""")
def rolling_features_shifted(spark, d):
    return _rounded(FE.load_features(value_panel(spark, d), "v3"), ["rolling_mean_24", "rolling_std_24", "rolling_min_24", "rolling_max_24", "rolling_mean_168", "rolling_std_168"])


def _cyc(x, p, name):
    return f"round(sin(2 * pi() * {x} / {p}), 9) + 0.0 AS {name}_sin, round(cos(2 * pi() * {x} / {p}), 9) + 0.0 AS {name}_cos"


@query(f"WITH {GRID} SELECT timestamp, building_id, {_cyc('hour(timestamp)', '24.0', 'hour')}, {_cyc('(isodow(timestamp) - 1)', '7.0', 'dow')}, {_cyc('dayofyear(timestamp)', '365.25', 'doy')}, {_cyc('month(timestamp)', '12.0', 'month')}, (isodow(timestamp) >= 6)::DOUBLE AS is_weekend FROM grid")
def calendar_cyclic(spark, d):
    df = FE.calendar_features(value_panel(spark, d), "v3", (2024, 2024))
    return _rounded(df, ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "doy_sin", "doy_cos", "month_sin", "month_cos", "is_weekend"], 9)


@query("""SELECT DISTINCT o_orderdate::TIMESTAMP AS timestamp, (month(o_orderdate) = 1 AND isodow(o_orderdate) = 1 AND day(o_orderdate) BETWEEN 15 AND 21) OR (month(o_orderdate) = 2 AND isodow(o_orderdate) = 1 AND day(o_orderdate) BETWEEN 15 AND 21)
 OR (month(o_orderdate) = 5 AND isodow(o_orderdate) = 1 AND day(o_orderdate) >= 25) OR (month(o_orderdate) = 9 AND isodow(o_orderdate) = 1 AND day(o_orderdate) <= 7) OR (month(o_orderdate) = 10 AND isodow(o_orderdate) = 1 AND day(o_orderdate) BETWEEN 8 AND 14)
 OR (month(o_orderdate) = 11 AND isodow(o_orderdate) = 4 AND day(o_orderdate) BETWEEN 22 AND 28) OR (isodow(o_orderdate) <= 5 AND strftime(o_orderdate, '%m%d') IN ('0101', '0704', '1111', '1225'))
 OR (isodow(o_orderdate) = 5 AND strftime(o_orderdate, '%m%d') IN ('1231', '0703', '1110', '1224')) OR (isodow(o_orderdate) = 1 AND strftime(o_orderdate, '%m%d') IN ('0102', '0705', '1112', '1226')) AS holiday FROM orders""")
def holiday_flag(spark, d):
    from ..functions.scalars import is_federal_holiday

    days = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp")).distinct()
    return days.withColumn("holiday", is_federal_holiday(F.col("timestamp"), 1992, 2005))


_WEATHER_GRID = f"""{PANEL}, {WEATHER}, wgrid AS (SELECT g.timestamp, g.site_id, w.air_temperature, w.dew_temperature, w.wind_speed FROM (SELECT s.site_id, t.timestamp FROM (VALUES ('site0'), ('site1'), ('site2')) s(site_id),
 (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS timestamp) t) g LEFT JOIN weather w USING (timestamp, site_id))"""


def _wroll(n, a):
    frame = f"(PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN {a} PRECEDING AND 24 PRECEDING)"
    return f"CASE WHEN count(air_temperature) OVER {frame} >= {n} THEN round(avg(air_temperature) OVER {frame} + {_HAIR}, 6) END"


_WF = f"""wf AS (SELECT timestamp, site_id, lag(air_temperature, 24) OVER w AS air_temperature_lag_24, lag(air_temperature, 48) OVER w AS air_temperature_lag_48, lag(air_temperature, 168) OVER w AS air_temperature_lag_168,
 lag(dew_temperature, 24) OVER w AS dew_temperature_lag_24, lag(wind_speed, 24) OVER w AS wind_speed_lag_24, {_wroll(6, 47)} AS air_temperature_mean_24_lag_24, {_wroll(42, 191)} AS air_temperature_mean_168_lag_24
 FROM wgrid WINDOW w AS (PARTITION BY site_id ORDER BY timestamp))"""


def _grid(spark, d):
    return W.prepare(weather(spark, d), ["site0", "site1", "site2"], "2024-01-01 00:00:00", "2024-01-30 23:00:00")


@query(f"WITH {_WEATHER_GRID}, {_WF} SELECT * FROM wf")
def weather_features(spark, d):
    df = FE.weather_features(_grid(spark, d))
    return df.select("timestamp", "site_id", *[_round(c) if "mean" in c else c for c in FE.WEATHER_V3])


@query(f"WITH {_WEATHER_GRID}, {_WF} SELECT panel.timestamp, panel.building_id, panel.load, wf.air_temperature_lag_24, wf.air_temperature_mean_24_lag_24 FROM panel LEFT JOIN wf USING (timestamp, site_id)")
def weather_join(spark, d):
    df = value_panel(spark, d).join(FE.weather_features(_grid(spark, d)), ["site_id", "timestamp"], "left")
    return df.select(*_KEY, "load", "air_temperature_lag_24", _round("air_temperature_mean_24_lag_24"))


# seasonal naive and its evaluation over three conditions ------------------

def conditions(spark, d):
    """reference, corrupted, and remediated (lost or changed readings become yesterday's)."""
    ref = value_panel(spark, d)
    bad = corrupted_panel(spark, d)
    from ..operators.windows import ordered

    both = ref.join(bad.select(*_KEY, F.col("load").alias("c")), list(_KEY))
    fixed = both.withColumn("y", F.lag("load", 24).over(ordered())).withColumn("load", F.when(F.col("load").eqNullSafe(F.col("c")), F.col("load")).otherwise(F.col("y"))).select(*ref.columns)
    tag = lambda df, c: df.withColumn("condition", F.lit(c))
    return tag(ref, "reference").unionByName(tag(bad, "corrupted")).unionByName(tag(fixed, "remediated"))


_COND = f"""{CORRUPTED}, fixed AS (SELECT timestamp, building_id, site_id, primary_use, CASE WHEN load IS NOT DISTINCT FROM c THEN load ELSE y END AS load FROM (
  SELECT panel.*, corrupted.load AS c, lag(panel.load, 24) OVER (PARTITION BY panel.building_id ORDER BY panel.timestamp) AS y FROM panel JOIN corrupted USING (timestamp, building_id))),
cond AS (SELECT 'reference' AS condition, timestamp, building_id, site_id, primary_use, load FROM panel UNION ALL SELECT 'corrupted', timestamp, building_id, site_id, primary_use, load FROM corrupted UNION ALL SELECT 'remediated', timestamp, building_id, site_id, primary_use, load FROM fixed),
lagged AS (SELECT *, coalesce(lag(load, 168) OVER w, lag(load, 24) OVER w) AS naive, lag(load, 24) OVER w AS day FROM cond WINDOW w AS (PARTITION BY condition, building_id ORDER BY timestamp)),
forecast AS (SELECT condition, 'seasonal_naive' AS model, timestamp, building_id, site_id, primary_use, naive AS prediction FROM lagged WHERE timestamp > (SELECT min(timestamp) FROM panel) + INTERVAL 335 HOUR
  UNION ALL SELECT condition, 'yesterday', timestamp, building_id, site_id, primary_use, day FROM lagged WHERE timestamp > (SELECT min(timestamp) FROM panel) + INTERVAL 335 HOUR),
paired AS (SELECT f.*, p.load AS target FROM forecast f JOIN panel p USING (timestamp, building_id) WHERE f.prediction IS NOT NULL AND p.load IS NOT NULL),
pred AS (SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY timestamp, building_id) AS n FROM paired) WHERE n = 6),
diffs AS (SELECT building_id, abs(load - lag(load, 168) OVER (PARTITION BY building_id ORDER BY timestamp)) AS x FROM panel WHERE timestamp <= TIMESTAMP '{TRAIN_END}'),
scale AS (SELECT nullif(avg(x), 0) AS scale FROM diffs)"""
_M = """count(*) AS n, round(avg(abs(prediction - target)), 6) AS mae, round(sqrt(avg((prediction - target) ** 2)), 6) AS rmse, round(sum(abs(prediction - target)) / nullif(sum(abs(target)), 0), 6) AS wmape,
 round(avg(abs(prediction - target)) / (SELECT scale FROM scale), 6) AS mase, round(1 - sum((prediction - target) ** 2) / nullif(var_pop(target) * count(*), 0), 6) AS r2"""
_METRICS = ("mae", "rmse", "wmape", "mase", "r2")


def after_two_weeks(df, panel):
    """Hours from the panel's fifteenth day on, where both naive forecasts can look back."""
    first = panel.groupBy().agg(F.min("timestamp")).scalar()
    return df.where(F.col("timestamp") > first + F.expr("INTERVAL 335 HOUR"))


def predictions(spark, d):
    """Seasonal naive and yesterday's value from every condition, on common finite keys."""
    from ..operators.windows import Window

    w = Window.partitionBy("condition", "building_id").orderBy("timestamp")
    df = conditions(spark, d).withColumns({"lag_168": F.lag("load", 168).over(w), "lag_24": F.lag("load", 24).over(w)})
    df = after_two_weeks(df, value_panel(spark, d))
    both = F.inline(F.array(F.struct(F.lit("seasonal_naive").alias("model"), FE.seasonal_naive(df).alias("prediction")), F.struct(F.lit("yesterday").alias("model"), F.col("lag_24").alias("prediction"))))
    long = df.select("condition", *_KEY, "site_id", "primary_use", both)
    return E.common_keys(E.attach_targets(long, value_panel(spark, d)), 6)


def _train(spark, d):
    return value_panel(spark, d).where(F.col("timestamp") <= F.lit(TRAIN_END).cast("timestamp_ntz"))


def _scale(spark, d):
    return E.pooled_scale(_train(spark, d)).scalar()


def _metric_rounds(df):
    return df.withColumns({c: F.round(c, 6) for c in _METRICS})


@query(f"WITH {_COND} SELECT condition, model, timestamp, building_id, prediction, target FROM pred")
def common_key_alignment(spark, d):
    return predictions(spark, d).select("condition", "model", *_KEY, "prediction", "target")


@query(f"WITH {_COND} SELECT condition, timestamp, building_id, prediction FROM forecast WHERE model = 'seasonal_naive'")
def seasonal_naive(spark, d):
    from ..operators.windows import Window

    w = Window.partitionBy("condition", "building_id").orderBy("timestamp")
    df = conditions(spark, d).withColumns({"lag_168": F.lag("load", 168).over(w), "lag_24": F.lag("load", 24).over(w)})
    return after_two_weeks(df, value_panel(spark, d)).select("condition", *_KEY, FE.seasonal_naive(df).alias("prediction"))


@query(f"WITH {_COND} SELECT round(scale, 6) AS scale FROM scale")
def seasonal_scale_pooled(spark, d):
    return E.pooled_scale(_train(spark, d)).select(F.round("scale", 6).alias("scale"))


@query(f"WITH {_COND} SELECT building_id, round(nullif(avg(x), 0), 6) AS scale FROM diffs GROUP BY 1")
def seasonal_scale_by_entity(spark, d):
    return E.entity_scales(_train(spark, d)).select("building_id", F.round("scale", 6).alias("scale"))


@query(f"WITH {_COND}, s AS (SELECT building_id, nullif(avg(x), 0) AS scale FROM diffs GROUP BY 1) SELECT count(*) AS building_count, count(scale) AS valid_scale_count, count(*) - count(scale) AS undefined_scale_count, coalesce(string_agg(building_id, ';' ORDER BY building_id) FILTER (scale > 0), '') AS valid_scale_buildings, coalesce(string_agg(building_id, ';' ORDER BY building_id) FILTER (scale IS NULL), '') AS undefined_scale_buildings FROM s")
def scale_coverage(spark, d):
    return E.scale_coverage(E.entity_scales(_train(spark, d)))


@query(f"WITH {_COND} SELECT condition, model, {_M} FROM pred GROUP BY 1, 2")
def metric_set(spark, d):
    return _metric_rounds(E.metrics(predictions(spark, d), _scale(spark, d)))


_ENTITY = """, es AS (SELECT building_id, nullif(avg(x), 0) AS s FROM diffs GROUP BY 1), em AS (SELECT condition, model, building_id, count(*) AS n, avg(abs(prediction - target)) AS mae, any_value(s) AS s FROM pred LEFT JOIN es USING (building_id) GROUP BY 1, 2, 3)"""


@query(f"WITH {_COND}{_ENTITY} SELECT condition, model, building_id, n, round(mae, 6) AS mae, round(s, 6) AS reference_training_scale, round(mae / s, 6) AS mase FROM em")
def entity_mase(spark, d):
    df = E.entity_mase(predictions(spark, d), E.entity_scales(_train(spark, d)))
    return df.select("condition", "model", "building_id", "n", *[F.round(c, 6).alias(c) for c in ("mae", "reference_training_scale", "mase")])


@query(f"WITH {_COND}{_ENTITY} SELECT condition, model, round(avg(mae / s), 6) AS macro_mase, count(mae / s) AS buildings_evaluated, count(*) - count(mae / s) AS buildings_undefined FROM em GROUP BY 1, 2")
def macro_mase(spark, d):
    df = E.macro_mase(E.entity_mase(predictions(spark, d), E.entity_scales(_train(spark, d))))
    return df.withColumn("macro_mase", F.round("macro_mase", 6))


@query(f"""WITH {_COND}, q AS (SELECT *, year(timestamp) || 'Q' || quarter(timestamp) AS quarter FROM pred)
SELECT condition, model, 'site_id' AS group_dimension, site_id AS group_value, {_M} FROM q GROUP BY 1, 2, 4 UNION ALL SELECT condition, model, 'primary_use', primary_use, {_M} FROM q GROUP BY 1, 2, 4
UNION ALL SELECT condition, model, 'building_id', building_id, {_M} FROM q GROUP BY 1, 2, 4 UNION ALL SELECT condition, model, 'quarter', quarter, {_M} FROM q GROUP BY 1, 2, 4""")
def subgroup_metrics(spark, d):
    return _metric_rounds(E.subgroup_metrics(predictions(spark, d), _scale(spark, d)))


_PAIR = """, two AS (SELECT c.model, c.timestamp, c.building_id, abs(c.prediction - c.target) AS ce, abs(r.prediction - r.target) AS re FROM pred c JOIN pred r USING (timestamp, building_id, model) WHERE c.condition = 'corrupted' AND r.condition = 'remediated')"""


@query(f"WITH {_COND}{_PAIR} SELECT model, count(*) AS n, round(avg(ce), 6) AS corrupted_mae, round(avg(re), 6) AS remediated_mae, round(avg(re - ce), 6) AS mean_difference, 0::BIGINT AS targets_differ FROM two GROUP BY 1")
def paired_difference(spark, d):
    df = E.paired_difference(E.paired_rows(predictions(spark, d)))
    return df.withColumns({c: F.round(c, 6) for c in ("corrupted_mae", "remediated_mae", "mean_difference")})


@query(f"WITH {_COND}{_PAIR} SELECT model, building_id || '|' || isoyear(timestamp) || '-W' || lpad(weekofyear(timestamp)::VARCHAR, 2, '0') AS block, round(sum(re - ce), 5) AS total, count(*) AS n FROM two GROUP BY 1, 2")
def block_partial_agg(spark, d):
    rows = E.paired_rows(predictions(spark, d)).withColumn("block", week_block(F.col("building_id"), F.col("timestamp")))
    return B.block_sums(rows, "difference", "block", ["model"]).withColumn("total", F.round("total", 5)).select("model", "block", "total", "n")


@query(f"WITH {_COND} SELECT condition, count(load) AS training_rows, round(count(load) / (SELECT count(*) FROM cond WHERE condition = 'reference' AND timestamp <= TIMESTAMP '{TRAIN_END}'), 9) AS data_retained FROM cond WHERE timestamp <= TIMESTAMP '{TRAIN_END}' GROUP BY 1")
def data_retained(spark, d):
    return E.data_retained(conditions(spark, d), TRAIN_END).withColumn("data_retained", F.round("data_retained", 9))


@query(f"""WITH {_COND}, m AS (SELECT condition, model, avg(abs(prediction - target)) / (SELECT scale FROM scale) AS mase FROM pred GROUP BY 1, 2),
w AS (SELECT model, max(mase) FILTER (condition = 'reference') AS r, max(mase) FILTER (condition = 'corrupted') AS c, max(mase) FILTER (condition = 'remediated') AS m FROM m GROUP BY 1)
SELECT model, round((c - r) / r, 6) AS corruption_effect, round((m - c) / c, 6) AS repair_effect, round(1 - r / (SELECT r FROM w WHERE model = 'seasonal_naive'), 6) AS skill,
 CASE WHEN (m - r) / r < -0.005 THEN 'better_than_reference' WHEN (m - r) / r <= 0.005 THEN 'full' WHEN m < c THEN 'partial' ELSE 'none' END AS recovery FROM w""")
def narrative_ratios(spark, d):
    df = E.narrative(E.metrics(predictions(spark, d), _scale(spark, d)))
    return df.withColumns({c: F.round(c, 6) for c in ("corruption_effect", "repair_effect", "skill")})


@query(f"WITH {_COND}, x AS (SELECT timestamp, building_id, count(*) AS rows, count(DISTINCT target) AS targets FROM paired GROUP BY 1, 2) SELECT timestamp, building_id, rows FROM x WHERE rows <> 6")
def prediction_contract(spark, d):
    from ..operators import verify

    w = predictions_all(spark, d)
    return verify.prediction_contract(w, 6).select(*_KEY, "rows")


def predictions_all(spark, d):
    from ..operators.windows import Window

    w = Window.partitionBy("condition", "building_id").orderBy("timestamp")
    df = conditions(spark, d).withColumns({"lag_168": F.lag("load", 168).over(w), "lag_24": F.lag("load", 24).over(w)})
    df = after_two_weeks(df, value_panel(spark, d))
    both = F.inline(F.array(F.struct(F.lit("seasonal_naive").alias("model"), FE.seasonal_naive(df).alias("prediction")), F.struct(F.lit("yesterday").alias("model"), F.col("lag_24").alias("prediction"))))
    return E.attach_targets(df.select("condition", *_KEY, "site_id", "primary_use", both), value_panel(spark, d))


# direct horizons ----------------------------------------------------------

def _oroll(f, n, a):
    return _roll("load", f, n, a, "CURRENT ROW")


_DIRECT = f"""{PANEL}, of AS (SELECT *, lag(load, 24) OVER w AS origin_lag_24, lag(load, 168) OVER w AS origin_lag_168, {_oroll('mean', 6, 23)} AS origin_rolling_mean_24, {_oroll('std', 42, 167)} AS origin_rolling_std_168 FROM panel WINDOW w AS (PARTITION BY building_id ORDER BY timestamp)),
o AS (SELECT timestamp AS forecast_origin, building_id, load AS origin_load, origin_lag_24, origin_lag_168, origin_rolling_mean_24, origin_rolling_std_168 FROM of WHERE hour(timestamp) = 23),
ex AS (SELECT o.*, h.h::INT AS horizon_hours, o.forecast_origin + to_hours(h.h::INT) AS target_timestamp FROM o, (SELECT unnest(generate_series(1, 24)) AS h) h),
full_ AS (SELECT ex.*, p.load AS condition_target, a.load AS direct_lag_24, b.load AS direct_lag_168, count(p.timestamp) OVER (PARTITION BY ex.forecast_origin, ex.building_id) AS have FROM ex LEFT JOIN panel p ON p.building_id = ex.building_id AND p.timestamp = ex.target_timestamp
  LEFT JOIN panel a ON a.building_id = ex.building_id AND a.timestamp = ex.target_timestamp - INTERVAL 24 HOUR LEFT JOIN panel b ON b.building_id = ex.building_id AND b.timestamp = ex.target_timestamp - INTERVAL 168 HOUR),
direct AS (SELECT * EXCLUDE (have) FROM full_ WHERE have = 24),
ranges AS (SELECT forecast_origin, min(target_timestamp) AS lo, max(target_timestamp) AS hi, count(DISTINCT target_timestamp) AS n FROM direct GROUP BY 1),
labels AS (SELECT forecast_origin, CASE WHEN n <> 24 THEN 'excluded_incomplete_origin' WHEN hi <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN lo > TIMESTAMP '{TRAIN_END}' AND hi <= TIMESTAMP '{VALIDATION_END}' THEN 'validation'
  WHEN lo > TIMESTAMP '{VALIDATION_END}' AND hi <= {_LAST} THEN 'test' ELSE 'excluded_boundary_straddle' END AS partition FROM ranges)"""


@query(f"WITH {_DIRECT} SELECT * FROM direct")
def direct_examples(spark, d):
    df = D.examples(value_panel(spark, d))
    return df.select(
        "forecast_origin", "building_id", "horizon_hours", "target_timestamp", "condition_target", "origin_load", "origin_lag_24", "origin_lag_168",
        _round("origin_rolling_mean_24"), _round("origin_rolling_std_168"), "direct_lag_24", "direct_lag_168",
    )


@query(f"WITH {_DIRECT} SELECT partition, count(*) AS rows, count(DISTINCT forecast_origin) AS origins FROM direct JOIN labels USING (forecast_origin) GROUP BY 1")
def origin_partition_embargo(spark, d):
    df = D.origin_partitions(D.examples(value_panel(spark, d)), SPLIT)
    return df.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("forecast_origin").alias("origins"))


@query(f"""WITH {_DIRECT}, p AS (SELECT *, coalesce(direct_lag_168, direct_lag_24) AS prediction FROM direct JOIN labels USING (forecast_origin) WHERE partition = 'test'),
f AS (SELECT *, condition_target AS target FROM p WHERE prediction IS NOT NULL AND condition_target IS NOT NULL), v AS (SELECT *, count(DISTINCT horizon_hours) OVER (PARTITION BY forecast_origin, building_id) AS k FROM f)
SELECT horizon_hours, count(*) AS n, round(avg(abs(prediction - target)), 6) AS mae, round(sqrt(avg((prediction - target) ** 2)), 6) AS rmse FROM v WHERE k = 24 GROUP BY 1""")
def horizon_metrics(spark, d):
    df = D.origin_partitions(D.examples(value_panel(spark, d)), SPLIT).where("partition = 'test'")
    df = df.withColumns({"condition": F.lit("reference"), "model": F.lit("seasonal_naive"), "prediction": F.coalesce("direct_lag_168", "direct_lag_24"), "target": F.col("condition_target")})
    kept = E.complete_vectors(df.where("prediction IS NOT NULL AND target IS NOT NULL"), 1)
    return E.metrics(kept, None, ["horizon_hours"]).select("horizon_hours", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


# not expressible in SQL ----------------------------------------------------

#: Draws of every registered bootstrap, as the reference configures.
REPETITIONS = 500


@query()
def bootstrap_ci(spark, d):
    rows = E.paired_rows(predictions(spark, d))
    return B.row_bootstrap(rows, "difference", ["model"], list(_KEY), REPETITIONS, 42, by_index=True)


@query()
def block_bootstrap_ci(spark, d):
    rows = E.paired_rows(predictions(spark, d)).withColumn("block", week_block(F.col("building_id"), F.col("timestamp")))
    return B.block_bootstrap(rows, "difference", "block", ["model"], REPETITIONS, 42)


@query()
def poisson_bootstrap_ci(spark, d):
    return B.poisson_bootstrap(E.paired_rows(predictions(spark, d)), "difference", ["model"], [*_KEY, "model"], REPETITIONS, 42)


def _fit(name):
    def run(spark, d):
        df = FE.build(value_panel(spark, d), feature_set="v2", check=False)
        cut = F.lit(CUTOFF).cast("timestamp_ntz")
        return M.fit_predict(df.where(F.col("timestamp") < cut), df.where(F.col("timestamp") >= cut), name, M.ModelConfig(), FE.numeric_columns("v2"))

    run.__name__ = f"{name}_fit"
    return run


for _name in ("ridge", "hist_gradient_boosting", "random_forest"):
    QUERIES[f"{_name}_fit"] = _fit(_name)
