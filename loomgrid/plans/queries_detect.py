"""Queries on detectors, checks, gates, faults and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import faults as FA
from ..operators import quality as Q
from ..operators.detectors import QualityConfig, annotate, anomaly_masks, calibration_table
from ..operators.repair import quarantine, repair, repair_log
from . import inputs as I
from .inputs import CORRUPTED, COUNTS, CUTOFF, PANEL, corrupted_panel, count_panel, value_panel

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def masks_sql(source: str, config: QualityConfig) -> str:
    """The detectors as common table expressions over ``source``; the last is ``masked``."""
    c = config
    by = "PARTITION BY building_id ORDER BY timestamp"
    cal = f"timestamp < TIMESTAMP '{c.calibration_end}'" if c.calibration_end else "true"
    q = c.stuck_calibration_quantile
    thr = f"coalesce(greatest({c.stuck_threshold}, ceil(rq)::INT + 1), {c.stuck_threshold})" if q else str(c.stuck_threshold)
    if c.run_flagging == "whole_run":
        stuck, zero = "member AND run_rows >= eff", f"z AND zlen >= {c.long_zero_threshold}"
    else:
        stuck, zero = "rep AND rpos + 1 >= eff", f"z AND zpos >= {c.long_zero_threshold}"
    if c.zero_profile_min_ratio is not None:
        zero += " AND votes"
        vote = f"(z AND (prof IS NULL OR med IS NULL OR coalesce(prof > {c.zero_profile_min_ratio} * med, false)))"
    else:
        vote = "z"
    return f"""
d1 AS (SELECT *, lag(load) OVER ({by}) AS prior FROM {source}),
d2 AS (SELECT *, CASE WHEN count(prior) OVER f >= 6 THEN quantile_cont(prior, 0.5) OVER f END AS med, CASE WHEN count(prior) OVER g >= 6 THEN quantile_cont(prior, 0.5) OVER g END AS lvl,
   coalesce(load = 0, false) AS z, coalesce(load = prior AND load <> 0, false) AS rep, load IS NULL OR NOT coalesce(load = prior, false) AS chg, {cal} AS cal
   FROM d1 WINDOW f AS ({by} ROWS BETWEEN {c.causal_window - 1} PRECEDING AND CURRENT ROW), g AS ({by} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
d3 AS (SELECT *, abs(prior - med) AS dev, sum(chg::INT) OVER r AS crun, sum((NOT rep)::INT) OVER r AS rrun, sum((NOT z)::INT) OVER r AS zrun FROM d2 WINDOW r AS ({by} ROWS UNBOUNDED PRECEDING)),
d4 AS (SELECT *, CASE WHEN count(dev) OVER f >= 6 THEN quantile_cont(dev, 0.5) OVER f END AS mad, count(*) OVER (PARTITION BY building_id, crun) AS run_rows,
   CASE WHEN z THEN sum(z::INT) OVER (PARTITION BY building_id, zrun) ELSE 0 END AS zlen,
   CASE WHEN z THEN sum(z::INT) OVER (PARTITION BY building_id, zrun ORDER BY timestamp ROWS UNBOUNDED PRECEDING) ELSE 0 END AS zpos,
   CASE WHEN rep THEN sum(rep::INT) OVER (PARTITION BY building_id, rrun ORDER BY timestamp ROWS UNBOUNDED PRECEDING) ELSE 0 END AS rpos,
   CASE WHEN count(load) OVER p >= 2 THEN quantile_cont(load, 0.5) OVER p END AS prof
   FROM d3 WINDOW f AS ({by} ROWS BETWEEN {c.causal_window - 1} PRECEDING AND CURRENT ROW), p AS (PARTITION BY building_id, (isodow(timestamp) - 1) * 24 + hour(timestamp) ORDER BY timestamp ROWS BETWEEN {c.profile_weeks} PRECEDING AND 1 PRECEDING)),
d5 AS (SELECT *, load IS NOT NULL AND coalesce(load <> 0, false) AND run_rows >= 2 AS member, bool_or({vote}) OVER (PARTITION BY building_id, zrun) AS votes FROM d4),
d6 AS (SELECT *, sum((member AND cal)::INT) OVER (PARTITION BY building_id, crun) AS nat FROM d5),
d7 AS (SELECT *, CASE WHEN chg AND member AND cal AND nat >= 2 THEN nat END AS natrun FROM d6),
d8 AS (SELECT *, quantile_cont(natrun, {q or 0.5}) OVER (PARTITION BY building_id) AS rq FROM d7),
d9 AS (SELECT *, {thr} AS eff FROM d8),
masked AS (SELECT *, load IS NULL AS is_missing, coalesce(load < 0, false) AS is_negative,
   timestamp IS NOT NULL AND (coalesce(abs(load - med) / (1.4826 * nullif(mad, 0)) > {c.outlier_mad_z}, false) OR coalesce(med > 0 AND (load > {c.level_shift_ratio} * med OR load < med / {c.level_shift_ratio}), false)) AS is_outlier,
   {zero} AS is_long_zero, {stuck} AS is_stuck, timestamp IS NOT NULL AND coalesce(lvl > 0 AND (load > {c.level_shift_ratio} * lvl OR load < lvl / {c.level_shift_ratio}), false) AS is_level_shift FROM d9)"""


PLAIN = QualityConfig()
TAIL = QualityConfig(stuck_threshold=3, long_zero_threshold=3)
WHOLE = QualityConfig(run_flagging="whole_run", stuck_threshold=3, long_zero_threshold=3)
CALIBRATED = QualityConfig(run_flagging="whole_run", stuck_threshold=2, stuck_calibration_quantile=0.9, calibration_end=CUTOFF, long_zero_threshold=2, zero_profile_min_ratio=0.25, profile_weeks=3)
_PLAIN = f"WITH {PANEL}, {masks_sql('panel', PLAIN)}"
_TAIL = f"WITH {COUNTS}, {masks_sql('panel', TAIL)}"
_WHOLE = f"WITH {COUNTS}, {masks_sql('panel', WHOLE)}"
_CAL = f"WITH {COUNTS}, {masks_sql('panel', CALIBRATED)}"
_KEY = ("timestamp", "building_id")


@query(_PLAIN + " SELECT timestamp, building_id, round(med, 6) AS median FROM masked")
def rolling_median_168(spark, d):
    return annotate(value_panel(spark, d), PLAIN).select(*_KEY, F.round("median", 6).alias("median"))


@query(_PLAIN + " SELECT timestamp, building_id, round(mad, 5) AS mad, coalesce(abs(load - med) / (1.4826 * nullif(mad, 0)) > 12, false) AS by_z FROM masked")
def robust_mad_outlier(spark, d):
    z = F.abs(F.col("x") - F.col("median")) / (F.lit(1.4826) * F.nullif(F.col("mad"), F.lit(0.0)))
    return annotate(value_panel(spark, d), PLAIN).select(*_KEY, F.round("mad", 5).alias("mad"), F.coalesce(z > 12, F.lit(False)).alias("by_z"))


@query(_PLAIN + " SELECT timestamp, building_id, load FROM masked WHERE is_outlier")
def outliers(spark, d):
    return anomaly_masks(value_panel(spark, d), PLAIN).where("is_outlier").select(*_KEY, "load")


@query(_PLAIN + " SELECT timestamp, building_id, load FROM masked WHERE coalesce(med > 0 AND (load > 8 * med OR load < med / 8), false)")
def ratio_outlier(spark, d):
    m = F.col("median")
    return annotate(value_panel(spark, d), PLAIN).where((m > 0) & ((F.col("x") > m * 8) | (F.col("x") < m / 8))).select(*_KEY, "load")


@query(_PLAIN + " SELECT timestamp, building_id, load FROM masked WHERE is_level_shift")
def level_shift_24(spark, d):
    return anomaly_masks(value_panel(spark, d), PLAIN).where("is_level_shift").select(*_KEY, "load")


@query(_TAIL + " SELECT timestamp, building_id, rpos::BIGINT AS repeat_position, zpos::BIGINT AS zero_position FROM masked")
def run_position(spark, d):
    return annotate(count_panel(spark, d), TAIL).select(*_KEY, F.col("repeat_position").cast("long"), F.col("zero_position").cast("long"))


@query(_TAIL + " SELECT timestamp, building_id, run_rows::BIGINT AS run_rows, zlen::BIGINT AS zero_length FROM masked")
def run_length(spark, d):
    return annotate(count_panel(spark, d), TAIL).select(*_KEY, F.col("run_rows").cast("long"), F.col("zero_length").cast("long"))


@query(_TAIL + " SELECT timestamp, building_id FROM masked WHERE is_stuck")
def stuck_tail(spark, d):
    return anomaly_masks(count_panel(spark, d), TAIL).where("is_stuck").select(*_KEY)


@query(_WHOLE + " SELECT timestamp, building_id FROM masked WHERE is_stuck")
def stuck_whole_run(spark, d):
    return anomaly_masks(count_panel(spark, d), WHOLE).where("is_stuck").select(*_KEY)


@query(_CAL + """ SELECT building_id, count(*) FILTER (cal) AS calibration_rows, round(avg(rep::INT) FILTER (cal), 9) AS repeat_rate, round(avg(z::INT) FILTER (cal), 9) AS zero_rate,
 count(natrun) AS constant_run_count, round(max(rq), 9) AS constant_run_length_quantile, max(eff)::BIGINT AS stuck_threshold_effective FROM masked GROUP BY building_id""")
def calibrated_stuck_threshold(spark, d):
    t = calibration_table(count_panel(spark, d), CALIBRATED)
    return t.select(
        "building_id", "calibration_rows", F.round("repeat_rate", 9).alias("repeat_rate"), F.round("zero_rate", 9).alias("zero_rate"), "constant_run_count",
        F.round("constant_run_length_quantile", 9).alias("constant_run_length_quantile"), F.col("stuck_threshold_effective").cast("long"),
    )


@query(_CAL + " SELECT timestamp, building_id FROM masked WHERE is_stuck")
def stuck_calibrated(spark, d):
    return anomaly_masks(count_panel(spark, d), CALIBRATED).where("is_stuck").select(*_KEY)


@query(f"WITH {I.ZEROED}, {masks_sql('zeroed', TAIL)} SELECT timestamp, building_id FROM masked WHERE is_long_zero")
def zero_run_plain(spark, d):
    return anomaly_masks(I.zeroed_panel(spark, d), TAIL).where("is_long_zero").select(*_KEY)


@query(_CAL + " SELECT timestamp, building_id FROM masked WHERE is_long_zero")
def zero_run_profile_exempt(spark, d):
    return anomaly_masks(count_panel(spark, d), CALIBRATED).where("is_long_zero").select(*_KEY)


@query(_CAL + " SELECT timestamp, building_id, round(prof, 6) AS profile FROM masked")
def hour_of_week_profile(spark, d):
    return annotate(count_panel(spark, d), CALIBRATED).select(*_KEY, F.round("profile", 6).alias("profile"))


# checks and gate ---------------------------------------------------------

_CORR = f"""WITH {I.MESSY}, {masks_sql('messy', PLAIN)}, late AS (SELECT timestamp, building_id, place FROM (SELECT *,
  last_value(timestamp IGNORE NULLS) OVER (PARTITION BY building_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM messy) WHERE timestamp < seen),
lesser AS (SELECT timestamp, building_id FROM messy WHERE site_id IN (SELECT site_id FROM messy GROUP BY 1 HAVING count(*) < 0.01 * (SELECT count(*) FROM messy))
  OR primary_use IN (SELECT primary_use FROM messy GROUP BY 1 HAVING count(*) < 0.01 * (SELECT count(*) FROM messy))),
holes AS (SELECT sum(epoch(hi - lo) / 3600 + 1 - n)::BIGINT AS n FROM (SELECT min(timestamp) AS lo, max(timestamp) AS hi, count(DISTINCT timestamp) AS n FROM messy GROUP BY building_id)),
moved AS (SELECT building_id FROM messy GROUP BY 1 HAVING count(DISTINCT site_id) > 1 OR count(DISTINCT primary_use) > 1 OR count(DISTINCT timezone) > 1)"""
_COUNTS = f"""counted AS (
 SELECT 'TIMESTAMP_PARSE_ERROR' AS code, count(*) FILTER (timestamp IS NULL) AS n, count(*) AS d, 'fail' AS bad FROM masked
 UNION ALL SELECT 'TIMESTAMP_ORDER_ERROR', (SELECT count(*) FROM late), count(*), 'fail' FROM masked
 UNION ALL SELECT 'DUPLICATE_OBSERVATION_KEY', (SELECT coalesce(sum(k), 0) FROM (SELECT count(*) AS k FROM masked GROUP BY timestamp, building_id HAVING count(*) > 1)), count(*), 'fail' FROM masked
 UNION ALL SELECT 'LOAD_MISSING', count(*) FILTER (is_missing), count(*), 'warn' FROM masked
 UNION ALL SELECT 'LOAD_INFINITE', count(*) FILTER (isinf(load)), count(*), 'fail' FROM masked
 UNION ALL SELECT 'NEGATIVE_LOAD', count(*) FILTER (is_negative), count(*), 'fail' FROM masked
 UNION ALL SELECT 'ROBUST_OUTLIER', count(*) FILTER (is_outlier), count(*), 'warn' FROM masked
 UNION ALL SELECT 'LONG_ZERO_RUN', count(*) FILTER (is_long_zero), count(*), 'warn' FROM masked
 UNION ALL SELECT 'STUCK_SENSOR', count(*) FILTER (is_stuck), count(*), 'warn' FROM masked
 UNION ALL SELECT 'LEVEL_OR_UNIT_SHIFT', count(*) FILTER (is_level_shift), count(*), 'warn' FROM masked
 UNION ALL SELECT 'METADATA_JOIN_MISSING', count(*) FILTER (site_id IS NULL OR primary_use IS NULL), count(*), 'fail' FROM masked
 UNION ALL SELECT 'TIMEZONE_MISSING', count(*) FILTER (timezone IS NULL), count(*), 'warn' FROM masked
 UNION ALL SELECT 'COVERAGE_RARE_GROUP', (SELECT count(*) FROM lesser), count(*), 'warn' FROM masked
 UNION ALL SELECT 'INTERVAL_CONTINUITY_GAP', (SELECT n FROM holes), (SELECT n FROM holes) + count(*), 'warn' FROM masked
 UNION ALL SELECT 'SUBGROUP_METADATA_INSTABILITY', (SELECT count(*) FROM moved), count(DISTINCT building_id), 'fail' FROM masked)"""
RULES = {
    "LOAD_MISSING": {"basis": "rate", "warn_above": 0.0, "fail_above": 0.9},
    "NEGATIVE_LOAD": {"basis": "count", "warn_above": 0, "fail_above": 100000},
    "LEVEL_OR_UNIT_SHIFT": {"basis": "count", "warn_above": 1, "fail_above": 2},
}


def _issues(spark, d):
    return Q.quality_checks(I.messy_panel(spark, d), PLAIN, order_by="place")


@query(_CORR + f", {_COUNTS} SELECT code, CASE WHEN n > 0 THEN bad ELSE 'pass' END AS status, n::BIGINT AS count, d::BIGINT AS denominator, round(n / d, 9) AS rate FROM counted")
def issue_counts(spark, d):
    return _issues(spark, d).select("code", "status", "count", "denominator", F.round("rate", 9).alias("rate"))


_RULED = """ruled AS (SELECT code, n, CASE WHEN code = 'LOAD_MISSING' THEN CASE WHEN n / d > 0.9 THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END
 WHEN code = 'NEGATIVE_LOAD' THEN CASE WHEN n > 100000 THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END
 WHEN code = 'LEVEL_OR_UNIT_SHIFT' THEN CASE WHEN n > 2 THEN 'fail' WHEN n > 1 THEN 'warn' ELSE 'pass' END
 WHEN n > 0 THEN bad ELSE 'pass' END AS status FROM counted)"""


@query(_CORR + f", {_COUNTS}, {_RULED} SELECT code, status, n::BIGINT AS count FROM ruled")
def gate_thresholds(spark, d):
    return Q.apply_thresholds(_issues(spark, d), RULES).select("code", "status", "count")


@query(_CORR + f""", {_COUNTS}, {_RULED} SELECT CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS status, count(*) AS checks,
 count(*) FILTER (status = 'pass') AS pass_checks, count(*) FILTER (status = 'warn') AS warn_checks, count(*) FILTER (status = 'fail') AS fail_checks, sum(n)::BIGINT AS affected_observations,
 coalesce(string_agg(code, ';' ORDER BY code) FILTER (n > 0 AND code IN ('TIMESTAMP_PARSE_ERROR', 'DUPLICATE_OBSERVATION_KEY', 'METADATA_JOIN_MISSING', 'SUBGROUP_METADATA_INSTABILITY')), '') AS hard_failures FROM ruled""")
def gate_rollup(spark, d):
    return Q.gate(Q.apply_thresholds(_issues(spark, d), RULES))


_SAMPLED = """s AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY timestamp NULLS FIRST, building_id) - 1 AS sample_index, timestamp, building_id FROM (
 SELECT 'LOAD_MISSING' AS code, timestamp, building_id FROM masked WHERE is_missing UNION ALL SELECT 'NEGATIVE_LOAD', timestamp, building_id FROM masked WHERE is_negative
 UNION ALL SELECT 'ROBUST_OUTLIER', timestamp, building_id FROM masked WHERE is_outlier UNION ALL SELECT 'LONG_ZERO_RUN', timestamp, building_id FROM masked WHERE is_long_zero
 UNION ALL SELECT 'STUCK_SENSOR', timestamp, building_id FROM masked WHERE is_stuck UNION ALL SELECT 'LEVEL_OR_UNIT_SHIFT', timestamp, building_id FROM masked WHERE is_level_shift
 UNION ALL SELECT 'TIMESTAMP_PARSE_ERROR', timestamp, building_id FROM masked WHERE timestamp IS NULL UNION ALL SELECT 'TIMEZONE_MISSING', timestamp, building_id FROM masked WHERE timezone IS NULL
 UNION ALL SELECT 'TIMESTAMP_ORDER_ERROR', timestamp, building_id FROM late UNION ALL SELECT 'COVERAGE_RARE_GROUP', timestamp, building_id FROM lesser))"""


@query(_CORR + f", {_SAMPLED} SELECT code, sample_index::BIGINT AS sample_index, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, building_id FROM s WHERE sample_index < 5")
def issue_samples_top5(spark, d):
    log = Q.issue_log(_issues(spark, d)).where("building_id IS NOT NULL")
    return log.select("code", F.col("sample_index").cast("long").alias("sample_index"), "timestamp", "building_id")


@query(_CORR + f""", {_COUNTS}, {_SAMPLED} SELECT c.code, coalesce(s.sample_index, 0)::BIGINT AS sample_index, CASE WHEN coalesce(s.sample_index, 0) = 0 THEN c.n::BIGINT ELSE -1 END AS count
 FROM counted c LEFT JOIN (SELECT * FROM s WHERE sample_index < 5) s USING (code)""")
def issue_log_flatten(spark, d):
    return Q.issue_log(_issues(spark, d)).select("code", F.col("sample_index").cast("long").alias("sample_index"), F.coalesce("count", F.lit(-1)).alias("count"))


# faults ------------------------------------------------------------------

def _fixed_plan(spark, d):
    """A plan without draws: single faults by hour number, blocks of eight hours on two entities."""
    p = value_panel(spark, d).where(F.col("load").isNotNull() & (F.col("timestamp") < F.lit(CUTOFF).cast("timestamp_ntz")))
    h, b = I.hour_number(), F.col("building_id")
    kind = (
        F.when(h % 101 == 0, "missing_value").when(h % 103 == 0, "negative_value").when(h % 107 == 0, "positive_spike")
        .when((h >= 100) & (h < 108), "long_zero_block").when((h >= 200) & (h < 208), "stuck_segment").when((h >= 300) & (h < 308), "unit_scale_segment")
    )
    rows = p.withColumn("fault_type", kind).where("fault_type IS NOT NULL").withColumn("fault_id", F.concat("fault_type", F.lit(":"), b, F.lit(":"), (h / 100).cast("int").cast("string")))
    from pyspark.sql import Window

    first = Window.partitionBy("fault_id")
    return rows.select("fault_id", "fault_type", "building_id", "timestamp", "load", F.min_by("load", "timestamp").over(first).alias("first_load"))


_PLAN = f"""plan AS (SELECT fault_type || ':' || building_id || ':' || floor(h / 100)::INT AS fault_id, * FROM (SELECT timestamp, building_id, load, h, CASE WHEN h % 101 = 0 THEN 'missing_value' WHEN h % 103 = 0 THEN 'negative_value' WHEN h % 107 = 0 THEN 'positive_spike'
  WHEN h >= 100 AND h < 108 THEN 'long_zero_block' WHEN h >= 200 AND h < 208 THEN 'stuck_segment' WHEN h >= 300 AND h < 308 THEN 'unit_scale_segment' END AS fault_type
  FROM (SELECT *, {I.HOUR} AS h FROM panel) WHERE load IS NOT NULL AND timestamp < TIMESTAMP '{CUTOFF}') WHERE fault_type IS NOT NULL),
first AS (SELECT fault_id, arg_min(load, timestamp) AS f FROM plan GROUP BY 1),
faults AS (SELECT plan.*, load AS original_value, CASE fault_type WHEN 'missing_value' THEN NULL WHEN 'negative_value' THEN -abs(load) - 1 WHEN 'positive_spike' THEN greatest(abs(load), 1) * 30
  WHEN 'long_zero_block' THEN 0 WHEN 'stuck_segment' THEN f * 0.731 + 0.123 ELSE load * 100 END AS corrupted_value FROM plan JOIN first USING (fault_id))"""


@query(f"""WITH {PANEL}, {_PLAN} SELECT panel.timestamp, panel.building_id, round(CASE WHEN f.fault_id IS NULL THEN panel.load ELSE f.corrupted_value END, 5) AS load, f.fault_id IS NOT NULL AS seeded
 FROM panel LEFT JOIN faults f USING (timestamp, building_id)""")
def fault_apply(spark, d):
    suite = FA.apply_plan(value_panel(spark, d), _fixed_plan(spark, d), "medium")
    marked = suite.frame.join(suite.faults.select(*_KEY, F.lit(True).alias("seeded")), list(_KEY), "left")
    return marked.select(*_KEY, F.round("load", 5).alias("load"), F.coalesce("seeded", F.lit(False)).alias("seeded"))


@query(f"""WITH {PANEL}, {_PLAN} SELECT fault_id, fault_type, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp, count(DISTINCT (timestamp, building_id)) AS affected_key_count,
 sha256('[' || string_agg(DISTINCT '{{"building_id":"' || building_id || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '"}}', ',' ORDER BY '{{"building_id":"' || building_id || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '"}}') || ']') AS affected_keys_sha256 FROM faults GROUP BY 1, 2""")
def fault_event_rollup(spark, d):
    suite = FA.apply_plan(value_panel(spark, d), _fixed_plan(spark, d), "medium")
    return FA.events(suite.faults).select("fault_id", "fault_type", "start_timestamp", "end_timestamp", F.col("affected_key_count").cast("long"), "affected_keys_sha256")


@query(f"""WITH {PANEL}, c AS (SELECT * FROM panel WHERE load IS NOT NULL AND timestamp < TIMESTAMP '{CUTOFF}'),
s AS (SELECT *, coalesce(epoch(lead(timestamp) OVER w - timestamp) = 3600, false) AS ok FROM c WINDOW w AS (PARTITION BY building_id ORDER BY timestamp))
SELECT timestamp, building_id FROM (SELECT *, count(*) OVER r = 8 AND bool_and(ok) OVER q AND bool_and(load > 0) OVER r AS yes FROM s
 WINDOW r AS (PARTITION BY building_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), q AS (PARTITION BY building_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) WHERE yes""")
def fault_block_eligibility(spark, d):
    return FA.block_starts(value_panel(spark, d), 8, CUTOFF).where("starts_block").select(*_KEY)


_SEEDED = f"""{PANEL}, {_PLAN}, seeded AS (SELECT panel.* EXCLUDE (load), CASE WHEN f.fault_id IS NULL THEN panel.load ELSE f.corrupted_value END AS load FROM panel LEFT JOIN faults f USING (timestamp, building_id)), {masks_sql('seeded', PLAIN)}"""


@query(f"""WITH {_SEEDED}, flags AS (SELECT 'missing_value' AS fault_type, timestamp, building_id FROM masked WHERE is_missing UNION SELECT 'negative_value', timestamp, building_id FROM masked WHERE is_negative
 UNION SELECT 'positive_spike', timestamp, building_id FROM masked WHERE is_outlier OR is_level_shift UNION SELECT 'unit_scale_segment', timestamp, building_id FROM masked WHERE is_outlier OR is_level_shift
 UNION SELECT 'long_zero_block', timestamp, building_id FROM masked WHERE is_long_zero UNION SELECT 'stuck_segment', timestamp, building_id FROM masked WHERE is_stuck),
truth AS (SELECT DISTINCT fault_type, timestamp, building_id FROM faults), kinds AS (SELECT DISTINCT fault_type FROM truth),
t AS (SELECT fault_type, (SELECT count(*) FROM truth x WHERE x.fault_type = k.fault_type) AS nt, (SELECT count(*) FROM flags x WHERE x.fault_type = k.fault_type) AS nf,
  (SELECT count(*) FROM truth x JOIN flags y USING (fault_type, timestamp, building_id) WHERE x.fault_type = k.fault_type) AS tp, (SELECT count(*) FROM panel) AS n FROM kinds k)
SELECT fault_type, tp AS true_positive, nt - tp AS false_negative, nf - tp AS false_positive, greatest(n - nt - (nf - tp), 0) AS true_negative,
 round(tp / nullif(nf, 0), 9) AS precision, round(tp / nullif(nt, 0), 9) AS recall, round((nf - tp) / nullif(nf - tp + greatest(n - nt - (nf - tp), 0), 0), 9) AS false_positive_rate FROM t""")
def detector_confusion(spark, d):
    suite = FA.apply_plan(value_panel(spark, d), _fixed_plan(spark, d), "medium")
    got = FA.confusion(suite.frame, suite.faults, PLAIN)
    return got.select(*[F.round(c, 9).alias(c) if c in ("precision", "recall", "false_positive_rate") else F.col(c).cast("long").alias(c) if c != "fault_type" else c for c in got.columns])


@query()
def fault_draws(spark, d):
    """Seeded draws of the value suite (they follow the generator, which SQL has not)."""
    return FA.inject(value_panel(spark, d), cutoff=CUTOFF, seed=2024, severity="low").faults


# repair ------------------------------------------------------------------

REPAIR = QualityConfig(run_flagging="whole_run", stuck_calibration_quantile=0.999, calibration_end=CUTOFF, zero_profile_min_ratio=0.25, profile_weeks=3)


def repair_sql(source: str, config: QualityConfig, before: str | None, forward: int, hours: int, weeks: int, profile: bool) -> str:
    open_ = f"coalesce(timestamp < TIMESTAMP '{before}', false)" if before else "true"
    return f"""{masks_sql(source, config)},
r1 AS (SELECT *, {open_} AS opn, {open_} AND is_level_shift AS amb, {open_} AND (site_id IS NULL OR primary_use IS NULL) AS st,
  {open_} AND (is_missing OR is_negative OR is_outlier OR is_long_zero OR is_stuck OR is_level_shift) AS bad, (isodow(timestamp) - 1) * 24 + hour(timestamp) AS slot FROM masked),
r2 AS (SELECT *, CASE WHEN NOT bad THEN load END AS v FROM r1),
r3 AS (SELECT *, opn AND NOT bad AND NOT st AND v IS NOT NULL AS valid, (opn AND NOT bad AND NOT st AND v IS NOT NULL) OR (NOT opn AND v IS NOT NULL) AS rst FROM r2),
r4 AS (SELECT *, last_value(CASE WHEN rst THEN v END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastv, sum(rst::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS isl,
  coalesce(sum(valid::INT) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ord FROM r3 WINDOW w AS (PARTITION BY building_id ORDER BY timestamp), s AS (PARTITION BY building_id, slot ORDER BY timestamp)),
r5 AS (SELECT *, sum((opn AND NOT valid)::INT) OVER (PARTITION BY building_id, isl ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS pos,
  quantile_cont(CASE WHEN valid THEN v END, 0.5) OVER h AS hm, count(CASE WHEN valid THEN v END) OVER h AS hn FROM r4 WINDOW h AS (PARTITION BY building_id, slot ORDER BY ord RANGE BETWEEN {weeks} PRECEDING AND 1 PRECEDING)),
repaired AS (SELECT *, CASE WHEN NOT opn THEN 'protected' WHEN valid THEN 'valid'
   WHEN bad AND NOT st AND NOT amb AND NOT (is_long_zero AND coalesce(lastv = 0, false)) AND lastv IS NOT NULL AND pos <= {forward} THEN 'forward'
   WHEN {'true' if profile else 'false'} AND bad AND NOT st AND NOT amb AND pos <= {hours} AND hn >= 2 THEN 'profile' ELSE 'quarantined' END AS action,
   coalesce(nullif(concat_ws(';', CASE WHEN is_missing THEN 'missing_load' END, CASE WHEN is_negative THEN 'negative_load' END, CASE WHEN is_outlier THEN 'robust_outlier' END, CASE WHEN is_long_zero THEN 'long_zero_run' END,
     CASE WHEN is_stuck THEN 'stuck_sensor' END, CASE WHEN amb THEN 'ambiguous_level_or_unit_shift' END, CASE WHEN st THEN 'missing_metadata' END), ''), 'unresolved_quality_issue') AS why FROM r5),
done AS (SELECT timestamp, building_id, load AS original_value, site_id, primary_use, CASE WHEN action IN ('forward', 'profile') THEN 'repaired' ELSE action END AS status, action,
   CASE WHEN action IN ('protected', 'valid') THEN v WHEN action = 'forward' THEN lastv WHEN action = 'profile' THEN hm END AS load, CASE WHEN action NOT IN ('protected', 'valid') THEN why END AS reason FROM repaired)"""


_REPAIR = f"WITH {CORRUPTED}, {repair_sql('corrupted', REPAIR, CUTOFF, 3, 48, 3, True)}"


def _repaired(spark, d):
    return repair(corrupted_panel(spark, d), REPAIR, repair_before=CUTOFF, strategy="forward_then_profile", profile_weeks=3)


SUPPLIER_QUALITY = QualityConfig(causal_window=24, stuck_threshold=2, outlier_mad_z=6.0, level_shift_ratio=4.0, frequency_hours=24)
SUPPLIER_CUT = "1996-01-01 00:00:00"
_MANY = f"WITH {I.SUPPLIER_PANEL}, {masks_sql('panel', SUPPLIER_QUALITY)}"
_MANY_REPAIR = f"WITH {I.SUPPLIER_PANEL}, {repair_sql('panel', SUPPLIER_QUALITY, SUPPLIER_CUT, 3, 48, 8, True)}"


@query(_MANY + " SELECT timestamp, building_id, load, is_outlier, is_stuck, is_level_shift FROM masked WHERE is_outlier OR is_stuck OR is_level_shift")
def many_entity_masks(spark, d):
    """The detectors where entities are many and each has gaps."""
    tasks = I.supplier_tasks(spark, d)
    found = anomaly_masks(I.supplier_panel(spark, d, tasks), SUPPLIER_QUALITY, tasks)
    return found.where("is_outlier OR is_stuck OR is_level_shift").select(*_KEY, "load", "is_outlier", "is_stuck", "is_level_shift")


@query(_MANY_REPAIR + " SELECT building_id, status, reason, count(*) AS rows, round(sum(load), 4) AS load FROM done GROUP BY 1, 2, 3")
def many_entity_repair(spark, d):
    tasks = I.supplier_tasks(spark, d)
    done = repair(I.supplier_panel(spark, d, tasks), SUPPLIER_QUALITY, repair_before=SUPPLIER_CUT, strategy="forward_then_profile", profile_weeks=8, tasks=tasks)
    return done.groupBy("building_id", "status", "reason").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("load"), 4).alias("load"))


@query(_REPAIR + " SELECT status, reason, count(*) AS rows FROM done GROUP BY 1, 2")
def repair_status(spark, d):
    return _repaired(spark, d).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("rows"))


@query(_REPAIR + " SELECT timestamp, building_id, round(load, 6) AS load, status FROM done")
def repair_values(spark, d):
    return _repaired(spark, d).select(*_KEY, F.round("load", 6).alias("load"), "status")


@query(_REPAIR + """ SELECT timestamp, building_id, round(original_value, 6) AS original_value, round(load, 6) AS remediated_value, status, reason,
 CASE action WHEN 'forward' THEN 'past_only_forward_fill_limit_3h' WHEN 'profile' THEN 'past_only_hour_of_week_median_3w_limit_48h' ELSE 'preserve_key_with_null' END AS rule FROM done WHERE action IN ('forward', 'profile', 'quarantined')""")
def repair_actions(spark, d):
    log = repair_log(_repaired(spark, d))
    return log.withColumns({c: F.round(c, 6) for c in ("original_value", "remediated_value")})


@query(_REPAIR + " SELECT timestamp, building_id, round(original_value, 6) AS load, site_id, primary_use, reason FROM done WHERE action = 'quarantined'")
def quarantine_reasons(spark, d):
    return quarantine(_repaired(spark, d)).drop("condition").withColumn("load", F.round("load", 6))


_FORWARD = f"WITH {CORRUPTED}, {repair_sql('corrupted', PLAIN, None, 3, 48, 8, False)}"


@query(_FORWARD + " SELECT timestamp, building_id, round(load, 6) AS load, status FROM done")
def repair_forward_only(spark, d):
    return repair(corrupted_panel(spark, d), PLAIN).select(*_KEY, F.round("load", 6).alias("load"), "status")
