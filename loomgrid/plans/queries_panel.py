"""Queries on panels: scans, reshapes, joins, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import panel as P
from ..operators import quality as Q
from ..operators import split, verify
from ..operators import weather as W
from ..operators.detectors import QualityConfig
from ..operators.features import irregular_steps
from .inputs import (
    CORRUPTED, GRID, HOUR, MESSY, PANEL, RAW, SUPPLIERS, TRAIN_END, VALIDATION_END, WEATHER, corrupted_panel,
    daily_suppliers, hour_number, messy_panel, raw_panel, supplier_metadata, table, value_panel, weather,
)

QUERIES, ORACLES = {}, {}
SPLIT = split.Split(TRAIN_END, VALIDATION_END, "2024-01-30 23:00:00")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {RAW} SELECT timestamp, building_id, load, site_id, primary_use FROM raw")
def panel_hourly(spark, d):
    return raw_panel(spark, d).select("timestamp", "building_id", "load", "site_id", "primary_use")


@query(f"WITH {PANEL} SELECT timestamp, building_id, load FROM panel")
def panel_grid_complete(spark, d):
    return value_panel(spark, d).select("timestamp", "building_id", "load")


@query(f"WITH {RAW} SELECT timestamp, building_id, load, site_id, primary_use, 'reference' AS condition FROM raw")
def contract_projection(spark, d):
    text = raw_panel(spark, d).select(F.col("timestamp").cast("string").alias("timestamp"), F.concat(F.lit(" "), "building_id", F.lit(" ")).alias("building_id"), F.col("load").cast("string").alias("load"), "site_id", "primary_use")
    return P.contract(text, "reference")


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, nullif(trim(event_type), '') AS kind,
  TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events""")
def coercing_casts(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), S.text_or_null(F.col("event_type")).alias("kind"), F.col("event_type").try_cast("double").alias("not_a_number"))


@query(f"""WITH {PANEL}, k AS (SELECT DISTINCT building_id FROM panel)
SELECT timestamp, building_id, load FROM panel""")
def unpivot_wide(spark, d):
    """Long to wide and back: one column an entity, as meter files have it."""
    p = value_panel(spark, d)
    names = [r[0] for r in p.select("building_id").distinct().orderBy("building_id").collect()]
    wide = p.groupBy("timestamp").agg(*[F.max(F.when(F.col("building_id") == n, F.col("load"))).alias(n) for n in names])
    return P.wide_to_long(wide, ["timestamp"], names)


@query(f"""WITH {CORRUPTED} SELECT panel.timestamp, panel.building_id, panel.load AS reference_load, corrupted.load AS corrupted_load
FROM panel JOIN corrupted USING (timestamp, building_id)""")
def pivot_condition(spark, d):
    both = value_panel(spark, d).withColumn("condition", F.lit("reference")).unionByName(corrupted_panel(spark, d).withColumn("condition", F.lit("corrupted")))
    return P.pivot(both, ["timestamp", "building_id"], "condition", ["reference", "corrupted"], ["load"])


@query(f"""WITH {SUPPLIERS} SELECT daily.timestamp, daily.building_id, daily.load, meta.site_id, meta.primary_use
FROM daily LEFT JOIN meta ON daily.building_id = meta.building_id AND meta.building_id::INT % 7 <> 0""")
def metadata_left_join(spark, d):
    meta = supplier_metadata(spark, d).where("cast(building_id AS int) % 7 <> 0")
    return P.join_dimension(daily_suppliers(spark, d), meta.unionByName(meta)).select("timestamp", "building_id", "load", "site_id", "primary_use")


_BAD_META = """bad AS (SELECT CASE WHEN building_id::INT % 11 = 0 THEN NULL ELSE building_id END AS building_id, CASE WHEN building_id::INT % 13 = 0 THEN NULL ELSE site_id END AS site_id, primary_use FROM meta
  UNION ALL SELECT * FROM meta WHERE building_id::INT % 5 = 0)"""


def _bad_metadata(spark, d):
    m = supplier_metadata(spark, d)
    n = F.col("building_id").cast("int")
    return m.select(F.when(n % 11 != 0, F.col("building_id")).alias("building_id"), F.when(n % 13 != 0, F.col("site_id")).alias("site_id"), "primary_use").unionByName(m.where(n % 5 == 0))


@query(f"""WITH {SUPPLIERS}, {_BAD_META}, c AS (SELECT 'METADATA_DUPLICATE_KEY' AS code, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM bad WHERE building_id IS NOT NULL GROUP BY building_id HAVING count(*) > 1)) AS n, 'fail' AS s
  UNION ALL SELECT 'METADATA_MISSING_KEY', (SELECT count(*) FROM bad WHERE building_id IS NULL), 'fail'
  UNION ALL SELECT 'METADATA_REQUIRED_VALUE_MISSING', (SELECT count(*) FROM bad WHERE site_id IS NULL OR primary_use IS NULL), 'warn')
SELECT code, CASE WHEN n > 0 THEN s ELSE 'pass' END AS status, n::BIGINT AS count, (SELECT count(*) FROM bad) AS denominator FROM c""")
def metadata_checks(spark, d):
    return Q.metadata_checks(_bad_metadata(spark, d)).select("code", "status", "count", "denominator")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1")
def dedupe_keep_first(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return P.keep_first(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


@query("SELECT timestamp, building_id, n FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, event_type AS building_id, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 1")
def duplicate_keys(spark, d):
    e = table(spark, d, "events").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("timestamp"), F.col("event_type").alias("building_id"))
    return e.groupBy("timestamp", "building_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, event_type AS building_id, round(avg(value), 6) AS load, arg_min(user_id, event_id) AS site_id FROM events GROUP BY 1, 2""")
def duplicate_mean(spark, d):
    e = table(spark, d, "events").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("timestamp"), F.col("event_type").alias("building_id"), F.col("value").alias("load"), F.col("user_id").alias("site_id"), "event_id")
    return P.average_duplicates(e, ["event_id"]).select("timestamp", "building_id", F.round("load", 6).alias("load"), "site_id")


@query(f"""WITH {RAW} SELECT building_id, (epoch(max(timestamp) - min(timestamp)) / 3600)::BIGINT + 1 AS expected, count(DISTINCT timestamp) AS observed,
  (epoch(max(timestamp) - min(timestamp)) / 3600)::BIGINT + 1 - count(DISTINCT timestamp) AS missing FROM raw GROUP BY building_id""")
def gap_count(spark, d):
    return Q.gaps(raw_panel(spark, d))


@query(f"""WITH {SUPPLIERS}, p AS (SELECT daily.*, site_id, primary_use FROM daily LEFT JOIN meta USING (building_id)),
s AS (SELECT site_id, count(*) / (SELECT count(*) FROM p)::DOUBLE AS share FROM p GROUP BY 1), u AS (SELECT primary_use, count(*) / (SELECT count(*) FROM p)::DOUBLE AS share FROM p GROUP BY 1)
SELECT p.timestamp, p.building_id, p.site_id, p.primary_use FROM p JOIN s USING (site_id) JOIN u USING (primary_use) WHERE s.share < 0.03 OR u.share < 0.03""")
def rare_group(spark, d):
    p = P.join_dimension(daily_suppliers(spark, d), supplier_metadata(spark, d))
    flags = Q.row_flags(p, QualityConfig(rare_group_fraction=0.03, causal_window=24))
    return flags.where("COVERAGE_RARE_GROUP").select("timestamp", "building_id", "site_id", "primary_use")


@query("""SELECT o_custkey::VARCHAR AS building_id, count(DISTINCT o_orderstatus) AS site_id, count(DISTINCT o_orderpriority) AS primary_use FROM orders GROUP BY 1
HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def metadata_instability(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("building_id"), F.col("o_orderstatus").alias("site_id"), F.col("o_orderpriority").alias("primary_use"))
    return Q.unstable_entities(o)


_SPLIT_DAY = "1995-06-17 00:00:00"


def _late_suppliers(spark, d):
    p = P.join_dimension(daily_suppliers(spark, d), supplier_metadata(spark, d))
    n = F.col("building_id").cast("int")
    return p.where((n % 9 != 0) | (F.col("timestamp") < F.lit(_SPLIT_DAY).cast("timestamp_ntz"))).where((F.col("site_id") != "NATION_3") | (F.col("timestamp") >= F.lit(_SPLIT_DAY).cast("timestamp_ntz")))


_LATE = f"""p AS (SELECT daily.*, site_id, primary_use FROM daily LEFT JOIN meta USING (building_id) WHERE (building_id::INT % 9 <> 0 OR timestamp < TIMESTAMP '{_SPLIT_DAY}') AND (site_id <> 'NATION_3' OR timestamp >= TIMESTAMP '{_SPLIT_DAY}'))"""


@query(f"""WITH {SUPPLIERS}, {_LATE}, g AS (SELECT 'SPLIT_BUILDING_COVERAGE' AS code, 'fail' AS bad, building_id AS k, bool_or(timestamp < TIMESTAMP '{_SPLIT_DAY}') AND bool_or(timestamp >= TIMESTAMP '{_SPLIT_DAY}') AS ok FROM p GROUP BY building_id
 UNION ALL SELECT 'SUBGROUP_SPLIT_COVERAGE', 'warn', site_id || '/' || primary_use, bool_or(timestamp < TIMESTAMP '{_SPLIT_DAY}') AND bool_or(timestamp >= TIMESTAMP '{_SPLIT_DAY}') FROM p GROUP BY site_id, primary_use)
SELECT code, CASE WHEN count(*) FILTER (NOT ok) > 0 THEN any_value(bad) ELSE 'pass' END AS status, count(*) FILTER (NOT ok) AS count, count(*) AS denominator FROM g GROUP BY code""")
def split_coverage(spark, d):
    return Q.split_checks(_late_suppliers(spark, d), _SPLIT_DAY).select("code", "status", "count", "denominator")


@query(f"""WITH {RAW}, s AS (SELECT *, CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'winter' WHEN month(timestamp) <= 5 THEN 'spring' WHEN month(timestamp) <= 8 THEN 'summer' ELSE 'autumn' END AS season FROM raw)
SELECT 'site_id' AS dimension, site_id AS value, count(*) AS rows FROM s GROUP BY site_id UNION ALL SELECT 'primary_use', primary_use, count(*) FROM s GROUP BY primary_use
UNION ALL SELECT 'season', season, count(*) FROM s GROUP BY season UNION ALL SELECT 'timezone', timezone, count(*) FROM s GROUP BY timezone""")
def coverage_summary(spark, d):
    return Q.coverage(raw_panel(spark, d))


@query(f"WITH {PANEL} SELECT count(*) AS rows, count(DISTINCT building_id) AS buildings, min(timestamp) AS timestamp_min, max(timestamp) AS timestamp_max, count(*) - count(load) AS load_missing FROM panel")
def coverage_totals(spark, d):
    return Q.coverage_totals(value_panel(spark, d))


@query(f"""WITH {MESSY} SELECT timestamp, building_id, place FROM (SELECT *, last_value(timestamp IGNORE NULLS) OVER (PARTITION BY building_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM messy) WHERE timestamp < seen""")
def order_violations(spark, d):
    flags = Q.row_flags(messy_panel(spark, d), QualityConfig(causal_window=24), order_by="place")
    return flags.where("TIMESTAMP_ORDER_ERROR").select("timestamp", "building_id", "place")


@query(f"""WITH {SUPPLIERS}, t AS (SELECT *, row_number() OVER (PARTITION BY site_id, primary_use ORDER BY building_id) AS turn FROM meta)
SELECT building_id, site_id, primary_use, turn, row_number() OVER (ORDER BY turn, site_id, primary_use) AS place FROM t""")
def round_robin_select(spark, d):
    return P.round_robin(supplier_metadata(spark, d)).select("building_id", "site_id", "primary_use", F.col("turn").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))


@query("SELECT s_suppkey::VARCHAR AS building_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 10 <> 0)")
def absent_entities(spark, d):
    present = daily_suppliers(spark, d).where("cast(building_id AS int) % 10 <> 0").select("building_id").distinct()
    return supplier_metadata(spark, d).select("building_id").join(present, "building_id", "left_anti")


@query(f"WITH {RAW} SELECT timestamp, building_id, epoch(timestamp - before) / 3600 AS step_hours FROM (SELECT *, lag(timestamp) OVER (PARTITION BY building_id ORDER BY timestamp) AS before FROM raw) WHERE epoch(timestamp - before) <> 3600")
def hourly_grid_assertion(spark, d):
    return irregular_steps(raw_panel(spark, d)).select("timestamp", "building_id", "step_hours")


@query(f"""WITH {GRID} SELECT DISTINCT timestamp, hour(timestamp)::INT AS hour, (isodow(timestamp) - 1)::INT AS weekday, ((isodow(timestamp) - 1) * 24 + hour(timestamp))::INT AS hour_of_week,
 dayofyear(timestamp)::INT AS day_of_year, year(timestamp) || 'Q' || quarter(timestamp) AS quarter,
 'winter' AS season, isoyear(timestamp) || '-W' || lpad(weekofyear(timestamp)::VARCHAR, 2, '0') AS iso_week FROM grid""")
def date_parts(spark, d):
    ts = F.col("timestamp")
    return value_panel(spark, d).select("timestamp").distinct().select(
        ts, F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday"), S.hour_of_week(ts).alias("hour_of_week"), F.dayofyear(ts).alias("day_of_year"),
        S.quarter_label(ts).alias("quarter"), S.season(ts).alias("season"), F.substring(S.week_block(F.lit(""), ts), 2, 20).alias("iso_week"),
    )


@query(f"WITH {CORRUPTED} SELECT panel.timestamp, panel.building_id FROM panel JOIN corrupted c USING (timestamp, building_id) WHERE NOT (panel.load IS NOT DISTINCT FROM c.load OR coalesce(abs(c.load - panel.load) <= 1e-12 + 1e-10 * abs(panel.load), false))")
def changed_keys(spark, d):
    return verify.changed_keys(value_panel(spark, d), corrupted_panel(spark, d))


@query(f"WITH {CORRUPTED} SELECT panel.timestamp, panel.building_id, panel.load AS reference_load, c.load AS candidate_load FROM panel JOIN corrupted c USING (timestamp, building_id) WHERE panel.timestamp >= TIMESTAMP '2024-01-11' AND panel.load IS DISTINCT FROM c.load")
def condition_parity(spark, d):
    return verify.parity(value_panel(spark, d), corrupted_panel(spark, d), "2024-01-11 00:00:00")


def _told(spark, d):
    return value_panel(spark, d).where((hour_number() + F.length("building_id")) % 97 == 0).select("timestamp", "building_id")


@query(f"""WITH {CORRUPTED}, told AS (SELECT timestamp, building_id FROM numbered WHERE h % 97 = 0), changed AS (SELECT panel.timestamp, panel.building_id FROM panel JOIN corrupted c USING (timestamp, building_id) WHERE panel.load IS DISTINCT FROM c.load)
SELECT *, 'undocumented' AS kind FROM (SELECT * FROM changed EXCEPT SELECT * FROM told) UNION ALL SELECT *, 'ineffective' FROM (SELECT * FROM told EXCEPT SELECT * FROM changed)""")
def undocumented_changes(spark, d):
    return verify.documented_changes(value_panel(spark, d), corrupted_panel(spark, d), _told(spark, d))


@query(f"""WITH {CORRUPTED}, told AS (SELECT timestamp, building_id FROM numbered WHERE h % 97 = 0)
SELECT panel.timestamp, panel.building_id FROM panel JOIN corrupted c USING (timestamp, building_id) WHERE panel.load IS DISTINCT FROM c.load EXCEPT SELECT * FROM told""")
def remediation_footprint(spark, d):
    return verify.footprint(corrupted_panel(spark, d), value_panel(spark, d), _told(spark, d))


@query(f"""WITH {PANEL}, a AS (SELECT timestamp, building_id, count(*) AS n FROM raw GROUP BY 1, 2), b AS (SELECT timestamp, building_id, count(*) AS n FROM panel GROUP BY 1, 2)
SELECT coalesce(a.timestamp, b.timestamp) AS timestamp, coalesce(a.building_id, b.building_id) AS building_id, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows
FROM a FULL JOIN b ON a.timestamp = b.timestamp AND a.building_id = b.building_id WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def key_set_equality(spark, d):
    return verify.key_difference(raw_panel(spark, d), value_panel(spark, d))


@query(f"WITH {RAW} SELECT timestamp, building_id FROM raw WHERE {HOUR} % 41 = 0")
def metadata_equality(spark, d):
    a = raw_panel(spark, d)
    b = a.withColumn("site_id", F.when(hour_number() % 41 != 0, F.col("site_id")))
    return verify.attribute_difference(a, b)


@query(f"""WITH {RAW}, {WEATHER} SELECT g.timestamp, g.site_id, w.air_temperature, w.dew_temperature, w.wind_speed
FROM (SELECT s.site_id, t.timestamp FROM (VALUES ('site0'), ('site1'), ('site2')) s(site_id), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS timestamp) t) g LEFT JOIN weather w USING (timestamp, site_id)""")
def weather_grid(spark, d):
    w = weather(spark, d)
    doubled = w.unionByName(w)
    grid = W.prepare(doubled, ["site0", "site1", "site2"], "2024-01-01 00:00:00", "2024-01-30 23:00:00")
    return grid.select("timestamp", "site_id", *[F.round(c, 6).alias(c) for c in ("air_temperature", "dew_temperature", "wind_speed")])


@query(f"""WITH {RAW}, {WEATHER}, g AS (SELECT g.timestamp, g.site_id, w.air_temperature FROM (SELECT s.site_id, t.timestamp FROM (VALUES ('site0'), ('site1'), ('site2')) s(site_id), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS timestamp) t) g LEFT JOIN weather w USING (timestamp, site_id))
SELECT site_id, 'air_temperature' AS variable, round(avg((air_temperature IS NULL)::INT), 9) AS missing_rate FROM g GROUP BY site_id UNION ALL SELECT DISTINCT site_id, 'cloud_coverage', 1.0 FROM g""")
def weather_missing_rate(spark, d):
    grid = W.prepare(weather(spark, d), ["site0", "site1", "site2"], "2024-01-01 00:00:00", "2024-01-30 23:00:00")
    return W.missing_rates(grid, ["air_temperature", "cloud_coverage"]).withColumn("missing_rate", F.round("missing_rate", 9))


@query(f"""WITH {PANEL} SELECT CASE WHEN timestamp <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN timestamp <= TIMESTAMP '{VALIDATION_END}' THEN 'validation' ELSE 'test' END AS partition, count(*) AS rows, count(load) AS target_rows FROM panel GROUP BY 1""")
def partition_counts(spark, d):
    return split.counts(value_panel(spark, d), SPLIT)


@query(f"""WITH {RAW}, t AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS position, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM raw))
SELECT strftime(max(timestamp) FILTER (position = floor(n * 0.6) - 1), '%Y-%m-%d %H:%M:%S') AS train_end, strftime(max(timestamp) FILTER (position = floor(n * 0.8) - 1), '%Y-%m-%d %H:%M:%S') AS validation_end, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS test_end FROM t""")
def fraction_split_boundaries(spark, d):
    s = split.by_fractions(raw_panel(spark, d), 0.6, 0.2)
    return spark.createDataFrame([(s.train_end, s.validation_end, s.test_end)], "train_end string, validation_end string, test_end string")
