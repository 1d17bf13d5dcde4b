"""Leakage-safe features: every load or weather value is a day old or older."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cyclic, hours_between, is_federal_holiday
from .windows import feature_min_periods, ordered, rolling

# The horizon and the names of the feature sets.
HORIZON = 24
LOAD_V2 = ["lag_24", "lag_48", "lag_168", "rolling_mean_24", "rolling_std_24", "rolling_mean_168", "rolling_std_168"]
LOAD_V3 = ["lag_24", "lag_48", "lag_168", "lag_336", "rolling_mean_24", "rolling_std_24", "rolling_min_24", "rolling_max_24", "rolling_mean_168", "rolling_std_168"]
CALENDAR_V2 = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]
CALENDAR_V3 = [*CALENDAR_V2, "doy_sin", "doy_cos", "month_sin", "month_cos", "is_weekend", "is_us_federal_holiday"]
WEATHER_V3 = [
    "air_temperature_lag_24", "air_temperature_lag_48", "air_temperature_lag_168", "dew_temperature_lag_24",
    "wind_speed_lag_24", "air_temperature_mean_24_lag_24", "air_temperature_mean_168_lag_24",
]
CATEGORICAL = ["building_id", "site_id", "primary_use"]


def numeric_columns(feature_set: str = "v2", *, weather: bool = False) -> list[str]:
    sets = {"v2": LOAD_V2 + CALENDAR_V2, "v3": LOAD_V3 + CALENDAR_V3}
    if feature_set not in sets:
        raise ValueError(f"feature_set is one of {sorted(sets)}")
    if weather and feature_set != "v3":
        raise ValueError("weather features belong to feature_set 'v3'")
    return sets[feature_set] + (WEATHER_V3 if weather else [])


def irregular_steps(panel: DataFrame, key: str = "building_id") -> DataFrame:
    """Rows whose distance to the row before is not one hour."""
    step = hours_between(F.col("timestamp"), F.lag("timestamp").over(ordered(key)))
    return panel.withColumn("step_hours", step).where(F.col("step_hours") != 1)


def assert_hourly(panel: DataFrame, key: str = "building_id") -> None:
    if bad := irregular_steps(panel, key).count():
        raise ValueError(f"a complete hourly grid is needed; {bad} intervals are not an hour")


def lags(panel: DataFrame, steps: tuple[int, ...] = (24, 48, 168)) -> DataFrame:
    w = ordered("building_id")
    return panel.withColumns({f"lag_{k}": F.lag("load", k).over(w) for k in steps})


def load_features(panel: DataFrame, feature_set: str = "v2") -> DataFrame:
    """Lags, and statistics of windows that end a horizon before the row."""
    w, x = ordered("building_id"), F.col("load")
    columns = {f"lag_{k}": F.lag("load", k).over(w) for k in ((24, 48, 168) if feature_set == "v2" else (24, 48, 168, 336))}
    for size in (24, 168):
        least = feature_min_periods(size)
        columns[f"rolling_mean_{size}"] = rolling(x, "mean", size, least, w, HORIZON)
        columns[f"rolling_std_{size}"] = rolling(x, "std", size, least, w, HORIZON)
        if feature_set == "v3" and size == 24:
            columns["rolling_min_24"] = rolling(x, "min", size, least, w, HORIZON)
            columns["rolling_max_24"] = rolling(x, "max", size, least, w, HORIZON)
    return panel.withColumns(columns)


def calendar_features(panel: DataFrame, feature_set: str = "v2", years: tuple[int, int] | None = None) -> DataFrame:
    ts = F.col("timestamp")
    hour, dow = cyclic(F.hour(ts), 24), cyclic(F.weekday(ts), 7)
    columns = {"hour_sin": hour[0], "hour_cos": hour[1], "dow_sin": dow[0], "dow_cos": dow[1]}
    if feature_set == "v3":
        doy, month = cyclic(F.dayofyear(ts), 365.25), cyclic(F.month(ts), 12)
        if years is None:
            low, high = panel.agg(F.year(F.min("timestamp")), F.year(F.max("timestamp"))).first()
            years = (low or 2000, high or 2000)
        columns |= {
            "doy_sin": doy[0], "doy_cos": doy[1], "month_sin": month[0], "month_cos": month[1],
            "is_weekend": (F.weekday(ts) >= 5).cast("double"),
            "is_us_federal_holiday": is_federal_holiday(ts, *years).cast("double"),
        }
    return panel.withColumns(columns)


def weather_features(weather: DataFrame) -> DataFrame:
    """timestamp, site_id and the lagged weather of WEATHER_V3; one row per site and hour."""
    w, air = ordered("site_id"), F.col("air_temperature")
    columns = {f"air_temperature_lag_{k}": F.lag(air, k).over(w) for k in (24, 48, 168)}
    columns |= {"dew_temperature_lag_24": F.lag("dew_temperature", 24).over(w), "wind_speed_lag_24": F.lag("wind_speed", 24).over(w)}
    for size in (24, 168):
        columns[f"air_temperature_mean_{size}_lag_24"] = rolling(air, "mean", size, feature_min_periods(size), w, HORIZON)
    return weather.withColumns(columns).select("timestamp", "site_id", *WEATHER_V3)


def build(panel: DataFrame, *, feature_set: str = "v2", weather: DataFrame | None = None, check: bool = True, years: tuple[int, int] | None = None) -> DataFrame:
    numeric_columns(feature_set, weather=weather is not None)
    if check:
        assert_hourly(panel)
    df = calendar_features(load_features(panel, feature_set), feature_set, years)
    if weather is None:
        return df
    if check:
        assert_hourly(weather, "site_id")
        if not weather.groupBy("site_id", "timestamp").count().where("count > 1").isEmpty():
            raise ValueError("weather has duplicate keys")
    return df.join(weather_features(weather), ["site_id", "timestamp"], "left")


def seasonal_naive(df):
    """Last week's reading, else yesterday's."""
    return F.coalesce("lag_168", "lag_24")
