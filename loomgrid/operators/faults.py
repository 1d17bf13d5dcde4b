"""Seeded fault injection for validating detectors and repair.

Draws are made on the driver from a generator seeded once; they need only how
many rows are eligible (a count) and which row stands at a drawn position (a
lookup), so the panel itself never leaves the executors. Applying a plan is one
join with the plan's rows (one per corrupted key).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flag, hours_between, is_finite
from ..schemas import FAULT
from .detectors import QualityConfig, anomaly_masks
from .windows import ordered

# The six families in their order of placement.
FAMILIES = ("missing_value", "negative_value", "positive_spike", "long_zero_block", "stuck_segment", "unit_scale_segment")
BLOCKS = ("long_zero_block", "stuck_segment", "unit_scale_segment")
# Block length, spike factor and unit scale by severity.
SEVERITY = {
    "low": {"block": 4, "spike": 12.0, "scale": 10.0},
    "medium": {"block": 8, "spike": 30.0, "scale": 100.0},
    "high": {"block": 16, "spike": 75.0, "scale": 1000.0},
}
# A stuck reading is this line through the block's first value.
STUCK_SLOPE, STUCK_OFFSET = 0.731, 0.123
DOWNSTREAM, VALIDATION = "downstream_forecasting", "detector_validation"


@dataclass
class FaultSuite:
    frame: DataFrame
    faults: DataFrame


def event_counts(events_per_type: int | Mapping[str, int]) -> dict[str, int]:
    """How many events each family gets; families that a mapping omits get one."""
    if isinstance(events_per_type, Mapping):
        if unknown := sorted(set(events_per_type) - set(FAMILIES)):
            raise ValueError(f"unknown fault families: {unknown}")
        counts = {f: int(events_per_type.get(f, 1)) for f in FAMILIES}
    else:
        counts = dict.fromkeys(FAMILIES, int(events_per_type))
    if min(counts.values()) < 1:
        raise ValueError("every family has at least one event")
    return counts


def eligible(panel: DataFrame, cutoff: str) -> Column:
    return flag(F.col("timestamp") < F.lit(cutoff).cast("timestamp_ntz")) & is_finite(F.col("load"))


def block_starts(panel: DataFrame, length: int, cutoff: str) -> DataFrame:
    """Rows that can start a block: the next ``length`` candidates are hourly and positive.

    Candidates are finite rows before the cutoff; the result is the candidates
    with ``starts_block``.
    """
    w = ordered("building_id")
    df = panel.where(eligible(panel, cutoff))
    df = df.withColumns(
        {
            "step_ok": F.coalesce(hours_between(F.lead("timestamp").over(w), F.col("timestamp")) == 1, F.lit(False)),
            "positive": F.col("load") > 0,
        }
    )
    rows = w.rowsBetween(0, length - 1)
    steps = w.rowsBetween(0, length - 2)
    hourly = F.min("step_ok").over(steps) if length > 1 else F.lit(True)
    ok = (F.count(F.lit(1)).over(rows) == length) & hourly & F.min("positive").over(rows)
    return df.withColumn("starts_block", ok).drop("step_ok", "positive")


def _numbered(panel: DataFrame, cutoff: str, length: int) -> DataFrame:
    """Candidates in (entity, time) order: entity, position in the entity, and whether a block can start.

    Positions are per entity; the global order follows from the entities' counts,
    so nothing is sorted in one task.
    """
    order = Window.partitionBy("building_id").orderBy("timestamp")
    starts = block_starts(panel, length, cutoff)
    return starts.select(
        "building_id", "timestamp", "load", "starts_block",
        (F.row_number().over(order) - 1).alias("position"),
    )


Intervals = list[tuple[int, int]]


def _without(free: Intervals, low: int, high: int) -> Intervals:
    """The sorted, inclusive intervals less [low, high]."""
    out = []
    for a, b in free:
        if b < low or a > high:
            out.append((a, b))
            continue
        if a < low:
            out.append((a, low - 1))
        if b > high:
            out.append((high + 1, b))
    return out


def _nth(free: Intervals, n: int) -> int:
    for a, b in free:
        if n <= b - a:
            return a + n
        n -= b - a + 1
    raise IndexError(n)


class _Candidates:
    """Uniform draws over the candidates of a panel in (entity, position) order.

    The driver holds a count for each entity, and free intervals only of the
    entities that a draw has touched; those are read once, as islands of
    neighbouring block starts, so a draw runs one small job at most.
    """

    def __init__(self, rows: DataFrame, rng: np.random.Generator, length: int):
        self.rows, self.rng, self.length = rows, rng, length
        per = rows.groupBy("building_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("starts_block").alias("s"))
        self.counts = {r["building_id"]: (r["n"], r["s"]) for r in per.orderBy("building_id").collect()}
        self.cells: dict[str, Intervals] = {}
        self.starts: dict[str, Intervals] = {}

    def _touch(self, b: str) -> None:
        if b in self.cells:
            return
        island = F.col("position") - F.row_number().over(Window.partitionBy("building_id").orderBy("position"))
        found = self.rows.where((F.col("building_id") == b) & F.col("starts_block")).withColumn("island", island)
        ends = found.groupBy("island").agg(F.min("position").alias("a"), F.max("position").alias("z")).orderBy("a")
        self.starts[b] = [(r["a"], r["z"]) for r in ends.collect()]
        self.cells[b] = [(0, self.counts[b][0] - 1)]

    def _draw(self, which: int, known: dict[str, Intervals], size: int) -> tuple[str, int]:
        free = {b: sum(z - a + 1 for a, z in known[b]) if b in known else c[which] for b, c in self.counts.items()}
        total = sum(free.values())
        if total < 1:
            raise ValueError(f"not enough readings before the cutoff for a fault of {size} rows")
        choice = int(self.rng.integers(0, total))
        for b, n in free.items():
            if choice < n:
                break
            choice -= n
        self._touch(b)
        at = _nth(known[b], choice)
        self.cells[b] = _without(self.cells[b], at, at + size - 1)
        self.starts[b] = _without(self.starts[b], at - self.length + 1, at + size - 1)
        return b, at

    def single(self) -> tuple[str, int]:
        return self._draw(0, self.cells, 1)

    def block(self) -> tuple[str, int]:
        return self._draw(1, self.starts, self.length)


def draw_plan(panel: DataFrame, *, cutoff: str, seed: int, severity: str = "medium", events_per_type: int | Mapping[str, int] = 1, suite: str = DOWNSTREAM) -> DataFrame:
    """The keys to corrupt: fault_id, fault_type, building_id, position, offset, timestamp, load, first_load."""
    if severity not in SEVERITY:
        raise ValueError(f"severity is one of {sorted(SEVERITY)}")
    counts, length = event_counts(events_per_type), int(SEVERITY[severity]["block"])
    rows = _numbered(panel, cutoff, length).persist()
    try:
        drawn, pick = [], _Candidates(rows, np.random.default_rng(seed), length)
        for event in range(1, max(counts.values()) + 1):
            for family in FAMILIES:
                if event > counts[family]:
                    continue
                b, at = pick.block() if family in BLOCKS else pick.single()
                size = length if family in BLOCKS else 1
                drawn += [(f"{suite}:{family}:{event:03d}", family, b, at + k, k) for k in range(size)]
        plan = panel.sparkSession.createDataFrame(drawn, "fault_id string, fault_type string, building_id string, position int, offset int")
        found = rows.join(F.broadcast(plan), ["building_id", "position"])
        first = Window.partitionBy("fault_id")
        keyed = found.withColumn("first_load", F.min_by("load", "offset").over(first))
        kept = keyed.select("fault_id", "fault_type", "building_id", "position", "offset", "timestamp", "load", "first_load").collect()
        return panel.sparkSession.createDataFrame(kept, keyed.select("fault_id", "fault_type", "building_id", "position", "offset", "timestamp", "load", "first_load").schema)
    finally:
        rows.unpersist()


def corrupted_value(fault_type: Column, load: Column, first_load: Column, severity: str) -> Column:
    p = SEVERITY[severity]
    return (
        F.when(fault_type == "missing_value", F.lit(None).cast("double"))
        .when(fault_type == "negative_value", -F.abs(load) - 1.0)
        .when(fault_type == "positive_spike", F.greatest(F.abs(load), F.lit(1.0)) * p["spike"])
        .when(fault_type == "long_zero_block", F.lit(0.0))
        .when(fault_type == "stuck_segment", first_load * STUCK_SLOPE + STUCK_OFFSET)
        .when(fault_type == "unit_scale_segment", load * p["scale"])
    )


def apply_plan(panel: DataFrame, plan: DataFrame, severity: str, suite: str = DOWNSTREAM) -> FaultSuite:
    """Overwrite the planned readings; every key of the panel stays."""
    value = corrupted_value(F.col("fault_type"), F.col("load"), F.col("first_load"), severity)
    faults = plan.select(
        "fault_id", "timestamp", "building_id", F.col("load").alias("original_value"), value.alias("corrupted_value"),
        "fault_type", F.lit(severity).alias("severity"), F.lit("corrupted").alias("condition"), F.lit(suite).alias("suite"),
    )
    hit = faults.select("timestamp", "building_id", F.col("corrupted_value").alias("new__"), F.lit(True).alias("hit__"))
    frame = panel.join(F.broadcast(hit), ["timestamp", "building_id"], "left")
    frame = frame.withColumn("load", F.when(F.col("hit__"), F.col("new__")).otherwise(F.col("load")))
    if "condition" in panel.columns:
        frame = frame.withColumn("condition", F.lit("corrupted"))
    return FaultSuite(frame.select(*panel.columns), faults)


def inject(panel: DataFrame, *, cutoff: str, seed: int, severity: str = "medium", events_per_type: int | Mapping[str, int] = 1) -> FaultSuite:
    """The value-only suite."""
    plan = draw_plan(panel, cutoff=cutoff, seed=seed, severity=severity, events_per_type=events_per_type)
    out = apply_plan(panel, plan, severity)
    return FaultSuite(out.frame, enrich(out.faults))


def inject_structural(panel: DataFrame, *, cutoff: str, seed: int, severity: str = "medium", events_per_type: int | Mapping[str, int] = 1) -> FaultSuite:
    """The value suite at seed + 101, then one row removed, one doubled, one moved by two hours, one without a site."""
    plan = draw_plan(panel, cutoff=cutoff, seed=seed + 101, severity=severity, events_per_type=events_per_type, suite=VALIDATION)
    base = apply_plan(panel, plan, severity, VALIDATION)
    frame, faults, rng = base.frame, base.faults, np.random.default_rng(seed + 202)
    key = ["timestamp", "building_id"]
    spark = panel.sparkSession
    reserved = plan.select(*key)
    out = []
    boundary = F.lit(cutoff).cast("timestamp_ntz")

    def pick(df: DataFrame, without: DataFrame | None = None):
        rows = df.where(eligible(df, cutoff))
        if without is not None:
            rows = rows.join(F.broadcast(without), key, "left_anti")
        counts = [tuple(r) for r in rows.groupBy("building_id").count().orderBy("building_id").collect()]
        total = sum(n for _, n in counts)
        if not total:
            raise ValueError("not enough readings before the cutoff for the fault suite")
        choice = int(rng.integers(0, total))
        for b, n in counts:
            if choice < n:
                break
            choice -= n
        nth = F.row_number().over(Window.partitionBy("building_id").orderBy("timestamp")) - 1
        return rows.where(F.col("building_id") == b).withColumn("nth__", nth).where(F.col("nth__") == choice).drop("nth__").first()

    def record(row, kind: str, corrupted):
        out.append((f"{VALIDATION}:{kind}:001", row["timestamp"], row["building_id"], row["load"], corrupted, kind, severity, "corrupted", VALIDATION))

    def one(row) -> Column:
        return (F.col("timestamp") == F.lit(row["timestamp"]).cast("timestamp_ntz")) & (F.col("building_id") == row["building_id"])

    gone = pick(frame, reserved)
    record(gone, "missing_interval", None)
    frame = frame.where(~flag(one(gone)))
    twice = pick(frame)
    record(twice, "duplicate_key", twice["load"])
    frame = frame.unionByName(frame.where(one(twice)))
    moved = pick(frame.dropDuplicates(key))
    record(moved, "timestamp_shift", moved["load"])
    ahead = F.col("timestamp") + F.expr("INTERVAL 2 HOURS")
    shifted = F.when(ahead < boundary, ahead).otherwise(F.col("timestamp") - F.expr("INTERVAL 2 HOURS"))
    frame = frame.withColumn("timestamp", F.when(flag(one(moved)), shifted).otherwise(F.col("timestamp")))
    blank = pick(frame.dropDuplicates(key))
    record(blank, "metadata_mismatch", None)
    frame = frame.withColumn("site_id", F.when(~flag(one(blank)), F.col("site_id")))
    return FaultSuite(frame, enrich(faults.unionByName(spark.createDataFrame(out, FAULT))))


def _event_columns(faults: DataFrame) -> DataFrame:
    keys = F.array_sort(F.collect_set(F.struct("building_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))))
    return faults.groupBy("fault_id", "suite", "fault_type", "severity").agg(
        F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp"),
        F.size(keys).alias("affected_key_count"), F.sha2(F.to_json(keys), 256).alias("affected_keys_sha256"),
    )


def events(faults: DataFrame) -> DataFrame:
    """One row for each fault event: its range, key count and digest of its keys (an event is a block at most)."""
    return _event_columns(faults)


def enrich(faults: DataFrame) -> DataFrame:
    """Fault rows with what their event says about itself."""
    own = [c for c in faults.columns if c not in ("start_timestamp", "end_timestamp", "affected_key_count", "affected_keys_sha256")]
    event = _event_columns(faults).drop("suite", "fault_type", "severity")
    return faults.select(*own).join(event, "fault_id")


def stale_metadata(faults: DataFrame) -> DataFrame:
    """Fault rows whose event columns do not follow from the keys."""
    again = _event_columns(faults).select(
        "fault_id", *[F.col(c).alias(f"{c}__") for c in ("start_timestamp", "end_timestamp", "affected_key_count", "affected_keys_sha256")]
    )
    same = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in ("start_timestamp", "end_timestamp", "affected_key_count", "affected_keys_sha256")]
    ok = same[0] & same[1] & same[2] & same[3]
    return faults.join(again, "fault_id", "left").where(~ok).select(*faults.columns)


def after_cutoff(faults: DataFrame, cutoff: str) -> DataFrame:
    """Fault rows that break the rule that faults lie strictly before the cutoff."""
    return faults.where(~flag(F.col("timestamp") < F.lit(cutoff).cast("timestamp_ntz")))


#: Masks that count as a detection of a family.
DETECTED_BY = {
    "missing_value": ["is_missing"],
    "negative_value": ["is_negative"],
    "positive_spike": ["is_outlier", "is_level_shift"],
    "long_zero_block": ["is_long_zero"],
    "stuck_segment": ["is_stuck"],
    "unit_scale_segment": ["is_outlier", "is_level_shift"],
    "duplicate_key": ["is_duplicate"],
    "metadata_mismatch": ["is_unjoined"],
}


def confusion(frame: DataFrame, faults: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """tp, fn, fp, tn and their rates for each fault type, on distinct keys.

    A removed or moved row counts as detected where its key is gone; a moved
    row also if the panel has duplicate keys.
    """
    key = ["timestamp", "building_id"]
    masked = anomaly_masks(frame, config)
    copies = F.count(F.lit(1)).over(Window.partitionBy(*key))
    masked = masked.withColumns({"is_duplicate": copies > 1, "is_unjoined": F.col("site_id").isNull() | F.col("primary_use").isNull()})
    used = sorted({m for ms in DETECTED_BY.values() for m in ms})
    keys = masked.groupBy(*key).agg(*[F.max(m).alias(m) for m in used], F.lit(True).alias("present"))
    truth = faults.select("fault_type", *key).distinct()
    kinds = truth.select("fault_type").distinct()
    by_kind = F.coalesce(
        *[F.when(F.col("fault_type") == k, F.greatest(*[F.col(m) for m in ms], F.lit(False))) for k, ms in DETECTED_BY.items()],
        F.lit(False),
    )
    universe = keys.groupBy().agg(F.count(F.lit(1)).alias("n"), F.max("is_duplicate").alias("dup"))
    flagged = keys.select(
        *key,
        F.explode(F.array_compact(F.array(*[F.when(F.greatest(*[F.col(m) for m in ms], F.lit(False)), F.lit(k)) for k, ms in DETECTED_BY.items()]))).alias("fault_type"),
    )
    flagged = flagged.join(F.broadcast(kinds), "fault_type").groupBy("fault_type").agg(F.count(F.lit(1)).alias("flagged"))
    hit = truth.join(keys, key, "left")
    gone = F.col("fault_type").isin("missing_interval", "timestamp_shift")
    hit = hit.withColumn("found", F.when(gone, F.col("present").isNull()).otherwise(by_kind & F.coalesce("present", F.lit(False))))
    per = hit.groupBy("fault_type").agg(
        F.count(F.lit(1)).alias("truth"), F.count_if("found").alias("found"), F.count_if(F.col("present")).alias("in_universe")
    )
    duplicated = F.coalesce(universe.select("dup").scalar(), F.lit(False))
    size = universe.select("n").scalar()
    shift = (F.col("fault_type") == "timestamp_shift") & (F.col("found") == 0) & duplicated
    per = per.join(flagged, "fault_type", "left").withColumn("tp", F.when(shift, F.col("truth")).otherwise(F.col("found")))
    fp = F.when(gone, F.lit(0)).otherwise(F.coalesce("flagged", F.lit(0)) - F.col("tp"))
    per = per.withColumns({"fn": F.col("truth") - F.col("tp"), "fp": fp})
    per = per.withColumn("tn", F.greatest(size - F.col("in_universe") - F.col("fp"), F.lit(0)))
    rate = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return per.select(
        "fault_type", F.col("tp").alias("true_positive"), F.col("fn").alias("false_negative"), F.col("fp").alias("false_positive"),
        F.col("tn").alias("true_negative"), rate("tp", "fp").alias("precision"), rate("tp", "fn").alias("recall"), rate("fp", "tn").alias("false_positive_rate"),
    )
