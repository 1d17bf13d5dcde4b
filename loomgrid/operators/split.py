"""Chronological partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    """Inclusive ends, as wall-clock text."""

    train_end: str
    validation_end: str
    test_end: str


def label(ts: Column, split: Split) -> Column:
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return F.when(ts <= at(split.train_end), "train").when(ts <= at(split.validation_end), "validation").otherwise("test")


def distinct_times(panel: DataFrame) -> DataFrame:
    """Distinct timestamps with their number in time order, counted by day and then over the days."""
    times = panel.where("timestamp IS NOT NULL").select("timestamp").distinct().withColumn("day", F.to_date("timestamp"))
    days = times.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("day").orderBy("timestamp"))
    return times.join(F.broadcast(days.select("day", before.alias("before"))), "day").select("timestamp", (F.col("before") + inside - 1).alias("position"))


def by_fractions(panel: DataFrame, train: float, validation: float) -> Split:
    """Boundaries at fractions of the distinct timestamps."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("fractions lie in (0, 1) and leave something to test")
    times = distinct_times(panel)
    n = times.count()
    if n < 3:
        raise ValueError("too few timestamps to split")
    at = max(0, int(n * train) - 1)
    to = max(at + 1, int(n * (train + validation)) - 1)
    found = {r["position"]: r["timestamp"] for r in times.where(F.col("position").isin(at, to, n - 1)).collect()}
    return Split(*(found[p].isoformat(sep=" ") for p in (at, to, n - 1)))


def explicit(panel: DataFrame, train_end: str, validation_end: str) -> Split:
    low, high = panel.agg(F.min("timestamp"), F.max("timestamp")).first()
    text = lambda t: t.isoformat(sep=" ")
    split = Split(train_end, validation_end, text(high))
    counts = {r[0]: r[1] for r in panel.groupBy(label(F.col("timestamp"), split)).count().collect()}
    order = [text(low), train_end.replace("T", " "), validation_end.replace("T", " "), text(high)]
    if not (order[0] <= order[1] < order[2] < order[3]) or any(not counts.get(p) for p in ("train", "validation", "test")):
        raise ValueError("boundaries are out of order or leave a partition empty")
    return split


def counts(panel: DataFrame, split: Split) -> DataFrame:
    return panel.groupBy(label(F.col("timestamp"), split).alias("partition")).agg(F.count(F.lit(1)).alias("rows"), F.count("load").alias("target_rows"))
