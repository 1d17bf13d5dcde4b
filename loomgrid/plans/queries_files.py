"""Queries on readers, sinks, selection, fault records and verification.

Files are written below the session's shared folder from the tables and read
back by the readers, so that a query holds the reader and the sink to the table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import faults as FA
from ..operators import panel as P
from ..operators import split, verify
from ..sources import readers, sinks
from .inputs import (
    CORRUPTED, CUTOFF, HOUR, PANEL, RAW, SUPPLIERS, TRAIN_END, VALIDATION_END, WEATHER, corrupted_panel, hour_number, raw_panel, supplier_metadata,
    value_panel, weather,
)
from .queries_detect import _PLAN, _fixed_plan

QUERIES, ORACLES = {}, {}
_KEY = ("timestamp", "building_id")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; below the temp folder only on a local master that has none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{at or tempfile.gettempdir()}/files_{uuid.uuid4().hex}/{name}"


# readers and sinks -------------------------------------------------------

@query(f"WITH {RAW} SELECT timestamp, building_id, CASE WHEN {HOUR} % 31 <> 0 THEN load END AS load FROM raw")
def meter_csv_long(spark, d):
    """A long meter file under other header names, with blanks around ids and loads that are no numbers."""
    bad = F.when(hour_number() % 31 == 0, F.lit("n/a")).otherwise(F.col("load").cast("string"))
    rows = raw_panel(spark, d).select(F.col("timestamp").alias(" Date_Time"), F.concat(F.lit(" "), "building_id", F.lit(" ")).alias("METER_ID"), bad.alias("Value"))
    at = scratch(spark, "meters.csv")
    sinks.write_csv(rows, at, compression=None)
    return readers.meters(spark, at)


def _wide(spark, d) -> tuple[str, list[str]]:
    """The value panel as a wide meter file in time order, and its entities."""
    p = value_panel(spark, d)
    names = [r[0] for r in p.select("building_id").distinct().orderBy("building_id").collect()]
    wide = p.groupBy("timestamp").agg(*[F.max(F.when(F.col("building_id") == n, F.col("load"))).alias(n) for n in names])
    at = scratch(spark, "wide.csv")
    sinks.write_csv(wide, at, ["timestamp"], compression=None)
    return at, names


@query(f"WITH {PANEL} SELECT timestamp, building_id, load FROM panel")
def meter_csv_wide(spark, d):
    return readers.meters(spark, _wide(spark, d)[0])


@query(f"""WITH {PANEL}, few AS (SELECT DISTINCT timestamp FROM panel ORDER BY timestamp LIMIT 200), two AS (SELECT DISTINCT building_id FROM panel ORDER BY building_id LIMIT 2)
SELECT timestamp, building_id, load FROM panel WHERE timestamp IN (SELECT timestamp FROM few) AND building_id IN (SELECT building_id FROM two)""")
def meter_csv_first_rows(spark, d):
    """Two entities' columns and the first 200 rows of the file."""
    at, names = _wide(spark, d)
    return readers.selected_wide(spark, at, names[:2], maximum_source_rows=200).select(*_KEY, "load")


@query(f"WITH {RAW} SELECT timestamp - INTERVAL 2 HOUR AS timestamp, building_id, load FROM raw WHERE length(building_id) > 5 UNION ALL SELECT timestamp, building_id, load FROM raw WHERE length(building_id) <= 5")
def offsets_to_utc(spark, d):
    """Times with an offset are turned to UTC, others are wall clock."""
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    rows = raw_panel(spark, d).select(F.when(F.length("building_id") > 5, F.concat(text, F.lit("+02:00"))).otherwise(text).alias("timestamp"), "building_id", "load")
    at = scratch(spark, "offsets.csv")
    sinks.write_csv(rows, at)
    return readers.meters(spark, at)


@query(f"WITH {SUPPLIERS} SELECT building_id, CASE WHEN building_id::INT % 6 <> 0 THEN site_id END AS site_id, primary_use, NULL::VARCHAR AS timezone FROM meta")
def metadata_csv(spark, d):
    m = supplier_metadata(spark, d)
    site = F.when(F.col("building_id").cast("int") % 6 != 0, F.col("site_id")).otherwise("  ")
    at = scratch(spark, "metadata.csv")
    sinks.write_csv(m.select(F.col("building_id").alias("Building"), site.alias("SiteId"), F.col("primary_use").alias("primaryspaceusage")), at)
    return readers.metadata(spark, at)


@query(f"WITH {WEATHER} SELECT timestamp, site_id, air_temperature, NULL::DOUBLE AS cloud_coverage, dew_temperature, 0.0::DOUBLE AS precip_depth_1hr, NULL::DOUBLE AS sea_lvl_pressure, wind_speed FROM weather")
def weather_csv(spark, d):
    """A weather file; infinite readings become null."""
    w = weather(spark, d).select(
        "timestamp", "site_id", F.col("air_temperature").alias("airTemperature"), F.col("cloud_coverage").alias("cloudCoverage"), F.col("dew_temperature").alias("dewTemperature"),
        F.col("precip_depth_1hr").alias("precipDepth1HR"), F.lit(float("inf")).alias("seaLvlPressure"), F.col("wind_speed").alias("windSpeed"),
    )
    at = scratch(spark, "weather.csv")
    sinks.write_csv(w, at)
    return readers.weather(spark, at)


_PUBLISHED = f"""WITH {CORRUPTED} SELECT timestamp, building_id, load, CASE WHEN length(building_id) > 5 THEN site_id ELSE 'unknown' END AS site_id, primary_use, 'corrupted' AS condition FROM corrupted"""


def _published(spark, d):
    p = corrupted_panel(spark, d).withColumn("site_id", F.when(F.length("building_id") > 5, F.col("site_id")))
    return P.contract(p, "corrupted")


@query(_PUBLISHED)
def condition_parquet(spark, d):
    """A condition table as runs write it, read back by its contract."""
    at = scratch(spark, "conditions")
    sinks.write_conditions(_published(spark, d).unionByName(P.contract(value_panel(spark, d), "reference")), at)
    return readers.condition(spark, f"{at}/condition=corrupted", "corrupted")


@query(_PUBLISHED)
def condition_csv(spark, d):
    at = scratch(spark, "corrupted.csv.gz")
    sinks.write_csv(_published(spark, d), at, ["timestamp", "building_id"])
    return readers.condition(spark, at, "corrupted")


# selection and splits ----------------------------------------------------

SITES = ("NATION_3", "NATION_8", "NATION_9", "NATION_12", "NATION_13", "NATION_19", "NATION_21")


@query(f"""WITH {SUPPLIERS}, absent AS (SELECT building_id FROM meta WHERE building_id::INT % 8 = 0), here AS (SELECT * FROM meta WHERE building_id::INT % 8 <> 0),
turned AS (SELECT *, row_number() OVER (PARTITION BY site_id, primary_use ORDER BY building_id) AS turn FROM here WHERE site_id IN ('NATION_3', 'NATION_8', 'NATION_9', 'NATION_12', 'NATION_13', 'NATION_19', 'NATION_21')),
placed AS (SELECT building_id, row_number() OVER (ORDER BY turn, site_id, primary_use) AS place FROM turned)
SELECT building_id, 'not_present_in_meter_header' AS reason, 0 AS place FROM absent UNION ALL SELECT building_id, 'site_filter', 0 FROM here WHERE site_id NOT IN ('NATION_3', 'NATION_8', 'NATION_9', 'NATION_12', 'NATION_13', 'NATION_19', 'NATION_21')
UNION ALL SELECT building_id, CASE WHEN place > 4 THEN 'maximum_building_count' ELSE 'chosen' END, CASE WHEN place <= 4 THEN place ELSE 0 END FROM placed""")
def entity_selection(spark, d):
    """Entities chosen by round robin within seven sites, four at most, and why the others are left out."""
    m = supplier_metadata(spark, d)
    present = [r[0] for r in m.where("cast(building_id AS int) % 8 <> 0").select("building_id").collect()]
    chosen, left_out = P.select_entities(m, present, P.Selection(site_ids=SITES, maximum_building_count=4))
    rows = [(b, "chosen", n) for n, b in enumerate(chosen, 1)] + [(b, why, 0) for b, why in left_out]
    return spark.createDataFrame(rows, "building_id string, reason string, place long")


@query(f"""WITH {RAW} SELECT CASE WHEN timestamp <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN timestamp <= TIMESTAMP '{VALIDATION_END}' THEN 'validation' ELSE 'test' END AS partition,
 count(*) AS rows, count(load) AS target_rows, (SELECT max(timestamp) FROM raw) AS test_end FROM raw GROUP BY 1""")
def explicit_split(spark, d):
    p = raw_panel(spark, d)
    s = split.explicit(p, TRAIN_END, VALIDATION_END)
    return split.counts(p, s).withColumn("test_end", F.lit(s.test_end).cast("timestamp_ntz"))


@query(f"""WITH {RAW}, p AS (SELECT CASE WHEN {HOUR} % 37 <> 0 THEN timestamp END AS timestamp, CASE WHEN {HOUR} % 41 <> 0 THEN building_id ELSE ' ' END AS building_id, CASE WHEN {HOUR} % 43 <> 0 THEN load ELSE 'inf'::DOUBLE END AS load FROM raw)
SELECT 'timestamps are missing: ' || count(*) AS violation FROM p WHERE timestamp IS NULL UNION ALL SELECT 'building ids are empty: ' || count(*) FROM p WHERE building_id = ' '
UNION ALL SELECT 'loads are not finite: ' || count(*) FROM p WHERE isinf(load) UNION ALL SELECT 'conditions are wrong: ' || count(*) FROM p UNION ALL SELECT 'keys are not unique'""")
def contract_violations(spark, d):
    h = hour_number()
    bad = raw_panel(spark, d).select(
        F.when(h % 37 != 0, F.col("timestamp")).alias("timestamp"), F.when(h % 41 != 0, F.col("building_id")).otherwise(" ").alias("building_id"),
        F.when(h % 43 != 0, F.col("load")).otherwise(float("inf")).alias("load"), "site_id", "primary_use", F.lit("reference").alias("condition"),
    )
    return spark.createDataFrame([(v,) for v in P.violations(bad, "corrupted")], "violation string")


# fault records -----------------------------------------------------------

def _suite(spark, d):
    return FA.apply_plan(value_panel(spark, d), _fixed_plan(spark, d), "medium")


@query(f"WITH {PANEL}, {_PLAN} SELECT fault_id, timestamp, building_id, fault_type FROM faults WHERE h % 5 = 0 OR h % 7 = 0 AND corrupted_value IS NOT NULL")
def fault_binding(spark, d):
    """Fault rows whose recorded values are not those of the panels."""
    s, h = _suite(spark, d), hour_number()
    told = s.faults.withColumns({"original_value": F.when(h % 5 == 0, F.col("original_value") + 1).otherwise(F.col("original_value")), "corrupted_value": F.when(h % 7 != 0, F.col("corrupted_value"))})
    return verify.bind_faults(told, value_panel(spark, d), s.frame).select("fault_id", *_KEY, "fault_type")


@query(f"WITH {PANEL}, {_PLAN}, n AS (SELECT fault_id, count(*) AS n FROM faults GROUP BY 1) SELECT fault_id, timestamp, building_id FROM faults JOIN n USING (fault_id) WHERE n > 1")
def fault_stale_events(spark, d):
    """Fault rows whose event no longer is what its keys say: the last key of every longer event was moved."""
    rich = FA.enrich(_suite(spark, d).faults)
    last = (F.col("timestamp") == F.col("end_timestamp")) & (F.col("affected_key_count") > 1)
    moved = rich.withColumn("timestamp", F.when(last, F.col("timestamp") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("timestamp")))
    back = F.when(F.second("timestamp") == 1, F.col("timestamp") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("timestamp"))
    return FA.stale_metadata(moved).select("fault_id", back.alias("timestamp"), "building_id")


@query(f"WITH {PANEL}, {_PLAN} SELECT fault_id, timestamp, building_id FROM faults WHERE timestamp >= TIMESTAMP '2024-01-08'")
def fault_cutoff(spark, d):
    return FA.after_cutoff(_suite(spark, d).faults, "2024-01-08 00:00:00").select("fault_id", *_KEY)


@query("""SELECT * FROM (VALUES ('missing_value', 3, 3), ('negative_value', 2, 2), ('positive_spike', 1, 1), ('long_zero_block', 1, 4), ('stuck_segment', 1, 4), ('unit_scale_segment', 1, 4),
 ('duplicate_key', 1, 1), ('metadata_mismatch', 1, 1), ('missing_interval', 1, 1), ('timestamp_shift', 1, 1)) AS t(fault_type, events, keys)""")
def structural_fault_counts(spark, d):
    """Events of each family and their distinct keys: as many as asked, none placed on another's key."""
    counts = {"missing_value": 3, "negative_value": 2}
    suite = FA.inject_structural(value_panel(spark, d), cutoff=CUTOFF, seed=11, severity="low", events_per_type=counts)
    return suite.faults.groupBy("fault_type").agg(F.count_distinct("fault_id").cast("int").alias("events"), F.count_distinct(*_KEY).cast("int").alias("keys"))


@query(f"WITH {PANEL} SELECT count(*) AS rows, 1::BIGINT AS sites_lost, 1::BIGINT AS keys_lost FROM panel")
def structural_fault_frame(spark, d):
    """The panel after the structural suite: one row less and one more, one site blanked, and the removed key gone."""
    p = value_panel(spark, d)
    suite = FA.inject_structural(p, cutoff=CUTOFF, seed=11, severity="low")
    gone = suite.faults.where("fault_type = 'missing_interval'").select(*_KEY)
    totals = suite.frame.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*[F.when(F.col("site_id").isNull(), F.col(k)) for k in _KEY]).alias("sites_lost"))
    return totals.withColumn("keys_lost", gone.join(suite.frame, list(_KEY), "left_anti").agg(F.count(F.lit(1))).scalar())


# verification ------------------------------------------------------------

@query(f"WITH {PANEL} SELECT timestamp, building_id, load + 1 AS target FROM panel WHERE load IS NOT NULL AND {HOUR} % 53 = 0")
def prediction_binding(spark, d):
    """Predictions whose target is not the reading of their key."""
    p = value_panel(spark, d)
    told = p.select(*_KEY, F.when(hour_number() % 53 == 0, F.col("load") + 1).otherwise(F.col("load")).alias("target"))
    return verify.unbound_predictions(told, p)


@query(f"WITH {PANEL} SELECT DISTINCT date_trunc('day', timestamp)::TIMESTAMP AS forecast_origin, building_id, 'reference' AS condition, 'naive' AS model FROM panel WHERE ({HOUR} + length(building_id)) % 59 = 0")
def incomplete_vectors(spark, d):
    """Days of which an hour is lost, as vectors of 24 horizons."""
    rows = value_panel(spark, d).where((hour_number() + F.length("building_id")) % 59 != 0)
    vectors = rows.select(
        F.date_trunc("DAY", "timestamp").cast("timestamp_ntz").alias("forecast_origin"), "building_id", F.lit("reference").alias("condition"), F.lit("naive").alias("model"),
        (F.hour("timestamp") + 1).alias("horizon_hours"),
    )
    return verify.incomplete_vectors(vectors)


@query(f"""WITH {CORRUPTED} SELECT panel.timestamp, panel.building_id FROM panel LEFT JOIN corrupted c ON panel.timestamp = c.timestamp AND panel.building_id = c.building_id
WHERE panel.load IS DISTINCT FROM c.load OR (epoch(panel.timestamp) / 3600)::BIGINT % 61 = 0""")
def table_comparison(spark, d):
    """Rows of a table that another does not reproduce, rows lost on one side included."""
    lost = (F.unix_seconds(F.col("timestamp").cast("timestamp")) / 3600).cast("long") % 61 == 0
    return verify.table_difference(corrupted_panel(spark, d).where(~lost).select(*_KEY, "load"), value_panel(spark, d).select(*_KEY, "load"), list(_KEY))
