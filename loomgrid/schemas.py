"""Column contracts of panels, weather, issues and faults."""

from __future__ import annotations

from pyspark.sql import types as T

# Conditions, keys and the rank of statuses.
CONDITIONS = ("reference", "corrupted", "remediated")
KEYS = ["timestamp", "building_id"]
FORECAST_KEYS = ["forecast_origin", "horizon_hours", "target_timestamp", "building_id"]
STATUS_RANK = {"pass": 0, "warn": 1, "fail": 2}

PANEL = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("building_id", T.StringType()),
        T.StructField("load", T.DoubleType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("primary_use", T.StringType()),
        T.StructField("condition", T.StringType()),
    ]
)

# Source column -> published column of the weather table.
WEATHER_COLUMNS = {
    "airTemperature": "air_temperature",
    "cloudCoverage": "cloud_coverage",
    "dewTemperature": "dew_temperature",
    "precipDepth1HR": "precip_depth_1hr",
    "seaLvlPressure": "sea_lvl_pressure",
    "windSpeed": "wind_speed",
}

# Header names that stand for a contract column, first match wins.
ALIASES = {
    "timestamp": ("timestamp", "datetime", "date_time", "time"),
    "building_id": ("building_id", "building", "meter_id"),
    "load": ("load", "value", "meter_reading"),
    "site_id": ("site_id", "site", "siteid"),
    "primary_use": ("primary_use", "primaryspaceusage", "primary_space_usage", "primary_space_use"),
    "timezone": ("timezone", "time_zone", "tz"),
}

ISSUE = (
    "code string, check string, status string, count long, denominator long, rate double, "
    "repairable boolean, columns array<string>, expected_rule string, action string, "
    "source_condition string, sample array<map<string,string>>"
)

FAULT = (
    "fault_id string, timestamp timestamp_ntz, building_id string, original_value double, "
    "corrupted_value double, fault_type string, severity string, condition string, suite string"
)
