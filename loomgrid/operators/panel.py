"""Panels: contract projection, grids, reshapes, dimension joins, selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_finite, no_nan, text_or_null
from ..schemas import ALIASES, CONDITIONS, KEYS, PANEL


def find_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The header that matches the first possible name, whatever its case and padding."""
    known = {c.strip().lower(): c for c in columns}
    return next((known[n] for n in names if n in known), None)


def contract(df: DataFrame, condition: str, order: bool = False) -> DataFrame:
    """The six contract columns, typed; columns that lack become null."""
    if condition not in CONDITIONS:
        raise ValueError(f"condition is one of {CONDITIONS}")
    columns = []
    for f in PANEL.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name == "condition":
            c = F.lit(condition)
        elif f.name == "timestamp":
            c = c.try_cast("timestamp_ntz")
        elif f.name == "load":
            c = no_nan(c.try_cast("double"))
        else:
            c = text_or_null(c.cast("string"))
        columns.append(c.alias(f.name))
    out = df.select(*columns)
    return out.orderBy(F.asc_nulls_first("timestamp"), F.asc_nulls_first("building_id")) if order else out


def violations(df: DataFrame, condition: str | None = None, unique: bool = True) -> list[str]:
    """What breaks the contract, found in one aggregation and one key count."""
    if df.columns != PANEL.fieldNames():
        return [f"columns are {df.columns}, not {PANEL.fieldNames()}"]
    wrong = F.col("condition").isNull() | ~F.col("condition").isin(*([condition] if condition else CONDITIONS))
    checks = {
        "timestamps are missing": F.col("timestamp").isNull(),
        "building ids are empty": F.col("building_id").isNull() | (F.trim("building_id") == ""),
        "loads are not finite": F.col("load").isNotNull() & ~is_finite(F.col("load")),
        "conditions are wrong": wrong,
    }
    row = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())]).first()
    out = [f"{name}: {n}" for name, n in zip(checks, row) if n]
    if unique and not df.groupBy(*KEYS).count().where("count > 1").isEmpty():
        out.append("keys are not unique")
    return out


def wide_to_long(wide: DataFrame, ids: Sequence[str], entities: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(ids), list(entities), "building_id", "load")


def pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], what: Sequence[str]) -> DataFrame:
    """One column for each value and measure, by conditional aggregation on known values."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(column) == v, F.col(w))).alias(f"{v}_{w}") for v in values for w in what]
    )


def hourly(events: DataFrame, time: str, entity: str, value: str) -> DataFrame:
    """Readings summed by hour and entity."""
    return events.groupBy(F.date_trunc("HOUR", time).cast("timestamp_ntz").alias("timestamp"), F.col(entity).cast("string").alias("building_id")).agg(
        F.sum(value).alias("load")
    )


def complete_grid(panel: DataFrame, key: str = "building_id", start: str | None = None, end: str | None = None) -> DataFrame:
    """Every hour between the first and the last (of the panel, or as given) for every entity.

    The grid is made from one row an entity, where it is needed; the readings
    join it on the key.
    """
    bounds = panel.groupBy().agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    first = F.lit(start).cast("timestamp_ntz") if start else bounds.select("a").scalar()
    last = F.lit(end).cast("timestamp_ntz") if end else bounds.select("b").scalar()
    grid = panel.select(key).distinct().select(key, F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("timestamp"))
    return grid.join(panel, ["timestamp", key], "left")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("row")).select(*keys, "row.*").select(*df.columns)


def average_duplicates(panel: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row a key: the mean of its readings and the attributes of its first row."""
    rest = [c for c in panel.columns if c not in (*KEYS, "load")]
    return panel.groupBy(*KEYS).agg(
        F.avg(no_nan(F.col("load"))).alias("load"), *[F.min_by(c, F.struct(*order)).alias(c) for c in rest]
    ).select(*panel.columns)


def join_dimension(panel: DataFrame, dimension: DataFrame, key: str = "building_id", order: Sequence[str] | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """Left join with one row a key; broadcast only if the dimension's size allows it."""
    clean = dimension.where(F.col(key).isNotNull())
    clean = keep_first(clean, [key], order or [c for c in clean.columns if c != key])
    small = clean.limit(broadcast_rows + 1).count() <= broadcast_rows
    return panel.join(F.broadcast(clean) if small else clean, key, "left")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{list(keys)} is not unique")


@dataclass(frozen=True)
class Selection:
    site_ids: tuple[str, ...] = ()
    building_ids: tuple[str, ...] = ()
    maximum_building_count: int | None = 12
    maximum_source_rows: int | None = None
    full_run: bool = False


def round_robin(metadata: DataFrame) -> DataFrame:
    """building_id, site_id, primary_use, turn, place: first of every (site, use), then second, ...

    Places count within a turn, whose rows are at most one a group, plus the
    rows of all turns before; only the table of one row a turn is ordered whole.
    """
    one = keep_first(metadata.where("building_id IS NOT NULL"), ["building_id"], [c for c in metadata.columns if c != "building_id"])
    turn = F.row_number().over(Window.partitionBy("site_id", "primary_use").orderBy("building_id"))
    turned = one.withColumn("turn", turn)
    before = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    offsets = turned.groupBy("turn").agg(F.count(F.lit(1)).alias("n")).select("turn", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before__"))
    place = F.row_number().over(Window.partitionBy("turn").orderBy(F.asc_nulls_last("site_id"), F.asc_nulls_last("primary_use")))
    placed = turned.withColumn("place", place).join(offsets, "turn").withColumn("place", (F.col("place") + F.col("before__")).cast("long"))
    return placed.select(*one.columns, "turn", "place")


def select_entities(metadata: DataFrame, available: Sequence[str], config: Selection) -> tuple[list[str], list[tuple[str, str]]]:
    """Chosen entity ids in order, and (id, reason) of those left out; loads are never looked at."""
    spark = metadata.sparkSession
    present = spark.createDataFrame([(a,) for a in available], "building_id string")
    absent = metadata.where("building_id IS NOT NULL").select("building_id").distinct().join(present, "building_id", "left_anti")
    out = [(r[0], "not_present_in_meter_header") for r in absent.orderBy("building_id").collect()]
    rows = metadata.join(F.broadcast(present), "building_id", "left_semi")
    if config.site_ids:
        other = rows.where(~F.coalesce(F.col("site_id").isin(*config.site_ids), F.lit(False)))
        out += [(r[0], "site_filter") for r in other.select("building_id").distinct().orderBy("building_id").collect()]
        rows = rows.where(F.col("site_id").isin(*config.site_ids))
    if config.building_ids:
        known = {r[0] for r in rows.select("building_id").distinct().collect()}
        if lost := [b for b in config.building_ids if b not in known]:
            raise ValueError(f"configured buildings are not available: {lost}")
        chosen = list(dict.fromkeys(config.building_ids))
    else:
        chosen = [r[0] for r in round_robin(rows).orderBy("place").select("building_id").collect()]
    if not config.full_run and config.maximum_building_count is not None:
        if config.maximum_building_count <= 0:
            raise ValueError("maximum_building_count is positive or null")
        out += [(b, "maximum_building_count") for b in chosen[config.maximum_building_count :]]
        chosen = chosen[: config.maximum_building_count]
    if not chosen:
        raise ValueError("the selection is empty")
    return chosen, out


def resolve(columns: Sequence[str], contract_column: str) -> str | None:
    return find_column(columns, ALIASES[contract_column])
