"""Panels derived from the star-schema tables, and the same panels in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators.windows import by_entity, tasks_for

CUTOFF = "2024-01-21 00:00:00"
TRAIN_END = "2024-01-20 23:00:00"
VALIDATION_END = "2024-01-23 23:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dims(df: DataFrame) -> DataFrame:
    """Site, use and zone of an event type, as a rule."""
    n = F.length("building_id")
    return df.withColumns(
        {
            "site_id": F.concat(F.lit("site"), (n % 3).cast("string")),
            "primary_use": F.concat(F.lit("use"), (n % 2).cast("string")),
            "timezone": F.lit("UTC"),
        }
    )


def raw_panel(spark: SparkSession, d: str) -> DataFrame:
    hourly = P.hourly(table(spark, d, "events"), "ts", "event_type", "value")
    return dims(hourly.withColumn("load", F.round("load", 6)))


def value_panel(spark: SparkSession, d: str) -> DataFrame:
    """All hours of all event types; hours without events are null."""
    grid = P.complete_grid(raw_panel(spark, d).select("timestamp", "building_id", "load"))
    return dims(grid)


def count_panel(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour; many repeats and zeros."""
    counted = table(spark, d, "events").groupBy(
        F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("timestamp"), F.col("event_type").alias("building_id")
    ).agg(F.count(F.lit(1)).cast("double").alias("load"))
    grid = P.complete_grid(counted)
    return dims(grid.withColumn("load", F.coalesce("load", F.lit(0.0))))


def hour_number(ts="timestamp"):
    return F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def corrupted_panel(spark: SparkSession, d: str) -> DataFrame:
    """The value panel with readings lost, scaled or negated by a rule, before the cutoff."""
    df = value_panel(spark, d)
    h = hour_number() + F.length("building_id")
    early = F.col("timestamp") < F.lit(CUTOFF).cast("timestamp_ntz")
    load = F.when(early & (h % 97 == 0), F.lit(None).cast("double")).when(early & (h % 113 == 0), F.col("load") * 100).when(early & (h % 131 == 0), -F.col("load")).otherwise(F.col("load"))
    return df.withColumn("load", load)


def messy_panel(spark: SparkSession, d: str) -> DataFrame:
    """The corrupted panel with hours left out, a time lost by entity, zones lost, a rare site that some entities
    change to, and an input order (place) in which one hour in fifty comes seven hours late."""
    hour, h = hour_number(), hour_number() + F.length("building_id")
    df = corrupted_panel(spark, d).where(h % 89 != 0).withColumn("place", hour * 10 + F.when(hour % 50 == 0, 75).otherwise(0))
    return df.withColumns(
        {
            "site_id": F.when((h % 367 == 5) & (F.length("building_id") > 5), "rare").otherwise(F.col("site_id")),
            "timezone": F.when(h % 211 != 0, F.col("timezone")),
            "timestamp": F.when(hour != 600, F.col("timestamp")),
        }
    )


def zeroed_panel(spark: SparkSession, d: str) -> DataFrame:
    """The count panel with five hours of zeros every sixty."""
    return count_panel(spark, d).withColumn("load", F.when(hour_number() % 60 < 5, F.lit(0.0)).otherwise(F.col("load")))


def supplier_tasks(spark: SparkSession, d: str) -> int:
    """Tasks for the suppliers' panel, which has no more rows than lineitem (counted from the files' footers)."""
    return tasks_for(table(spark, d, "lineitem").count())


def supplier_panel(spark: SparkSession, d: str, tasks: int | None = None) -> DataFrame:
    """Daily quantities of many entities, with their attributes."""
    joined = P.join_dimension(daily_suppliers(spark, d, tasks), supplier_metadata(spark, d))
    return joined.withColumn("load", F.col("load").cast("double"))


def daily_suppliers(spark: SparkSession, d: str, tasks: int | None = None) -> DataFrame:
    """Daily quantities of suppliers, a panel of many entities with gaps; with ``tasks``, hashed by entity before the sums."""
    rows = table(spark, d, "lineitem").select(
        F.date_trunc("DAY", "l_shipdate").cast("timestamp_ntz").alias("timestamp"), F.col("l_suppkey").cast("string").alias("building_id"), "l_quantity"
    )
    return (rows if tasks is None else by_entity(rows, tasks)).groupBy("timestamp", "building_id").agg(F.sum("l_quantity").alias("load"))


def supplier_metadata(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").cast("string").alias("building_id"), F.col("n_name").alias("site_id"), F.col("r_name").alias("primary_use"))


def weather(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in: statistics of the hour's events as weather of three sites (one hour in 29 is lost)."""
    e = table(spark, d, "events").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("timestamp"), F.concat(F.lit("site"), (F.length("event_type") % 3).cast("string")).alias("site_id"), "value", "user_id")
    w = e.groupBy("timestamp", "site_id").agg(
        F.round(F.avg("value"), 6).alias("air_temperature"), F.round(F.min("value"), 6).alias("dew_temperature"), F.round(F.max("value"), 6).alias("wind_speed"),
        F.avg("user_id").alias("sea_lvl_pressure"),
    )
    w = w.withColumns({"cloud_coverage": F.lit(None).cast("double"), "precip_depth_1hr": F.lit(0.0)})
    return w.where(hour_number() % 29 != 0)


#: The same inputs as common table expressions.
RAW = """raw AS (SELECT *, 'site' || (length(building_id) % 3) AS site_id, 'use' || (length(building_id) % 2) AS primary_use, 'UTC' AS timezone FROM (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, event_type AS building_id, round(sum(value), 6) AS load FROM events GROUP BY 1, 2))"""
GRID = """grid AS (SELECT b.building_id, t.timestamp, 'site' || (length(b.building_id) % 3) AS site_id, 'use' || (length(b.building_id) % 2) AS primary_use, 'UTC' AS timezone
  FROM (SELECT DISTINCT event_type AS building_id FROM events) b,
       (SELECT unnest(generate_series(date_trunc('hour', min(ts))::TIMESTAMP, date_trunc('hour', max(ts))::TIMESTAMP, INTERVAL 1 HOUR)) AS timestamp FROM events) t)"""
PANEL = f"""{RAW}, {GRID}, panel AS (SELECT grid.*, raw.load FROM grid LEFT JOIN raw USING (timestamp, building_id))"""
COUNTS = f"""{GRID}, panel AS (SELECT grid.*, coalesce(c.load, 0)::DOUBLE AS load FROM grid LEFT JOIN (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, event_type AS building_id, count(*)::DOUBLE AS load FROM events GROUP BY 1, 2) c USING (timestamp, building_id))"""
HOUR = "(epoch(timestamp - TIMESTAMP '2024-01-01') / 3600)::BIGINT"
CORRUPTED = f"""{PANEL}, numbered AS (SELECT *, {HOUR} + length(building_id) AS h FROM panel),
corrupted AS (SELECT * EXCLUDE (load, h), CASE WHEN timestamp < TIMESTAMP '{CUTOFF}' AND h % 97 = 0 THEN NULL
  WHEN timestamp < TIMESTAMP '{CUTOFF}' AND h % 113 = 0 THEN load * 100 WHEN timestamp < TIMESTAMP '{CUTOFF}' AND h % 131 = 0 THEN -load ELSE load END AS load FROM numbered)"""
MESSY = f"""{CORRUPTED}, messy AS (SELECT CASE WHEN {HOUR} <> 600 THEN timestamp END AS timestamp, building_id, load, primary_use,
  CASE WHEN ({HOUR} + length(building_id)) % 367 = 5 AND length(building_id) > 5 THEN 'rare' ELSE site_id END AS site_id,
  CASE WHEN ({HOUR} + length(building_id)) % 211 <> 0 THEN timezone END AS timezone, {HOUR} * 10 + CASE WHEN {HOUR} % 50 = 0 THEN 75 ELSE 0 END AS place
  FROM corrupted WHERE ({HOUR} + length(building_id)) % 89 <> 0)"""
ZEROED = f"""{COUNTS}, zeroed AS (SELECT * REPLACE (CASE WHEN {HOUR} % 60 < 5 THEN 0 ELSE load END AS load) FROM panel)"""
SUPPLIERS = """daily AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS timestamp, l_suppkey::VARCHAR AS building_id, sum(l_quantity) AS load FROM lineitem GROUP BY 1, 2),
meta AS (SELECT s_suppkey::VARCHAR AS building_id, n_name AS site_id, r_name AS primary_use FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
WEATHER = f"""weather AS (SELECT * FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, 'site' || (length(event_type) % 3) AS site_id, round(avg(value), 6) AS air_temperature,
  round(min(value), 6) AS dew_temperature, round(max(value), 6) AS wind_speed FROM events GROUP BY 1, 2) WHERE {HOUR} % 29 <> 0)"""
SUPPLIER_PANEL = f"""{SUPPLIERS}, panel AS (SELECT timestamp, daily.building_id, load::DOUBLE AS load, site_id, primary_use FROM daily LEFT JOIN meta USING (building_id))"""
