"""Panels from streams: hourly sums behind a watermark, and past-only forward repair.

Watermarks need TIMESTAMP, so wall-clock times are cast at the stream's edge.
The repair keeps two numbers for each entity (the last valid reading and the
length of the bad run), the part of the batch repair that needs no look-back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "timestamp timestamp, building_id string, original_value double, load double, status string"


def hourly(events: DataFrame, time: str, entity: str, value: str, late: str = "2 hours") -> DataFrame:
    """timestamp, building_id, load: sums of each hour, emitted once the watermark has passed it."""
    e = events.select(F.col(time).cast("timestamp").alias("at"), F.col(entity).cast("string").alias("building_id"), F.col(value).alias("v"))
    got = e.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "building_id").agg(F.sum("v").alias("load"))
    return got.select(F.col("window.start").alias("timestamp"), "building_id", "load")


def forward_repair(panel: DataFrame, forward_hours: int = 3) -> DataFrame:
    """Readings that are missing, negative or not finite take the last valid one, for so many rows of a bad run.

    Rows of a micro-batch are taken in time order; a batch holds no hour that
    an earlier one has passed (sort by event time upstream, as ``hourly`` does).
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, bad = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values("timestamp", kind="stable")
        out = []
        for ts, x in zip(rows["timestamp"], rows["load"]):
            valid = pd.notna(x) and abs(x) != float("inf") and x >= 0
            if valid:
                last, bad = float(x), 0
                out.append((ts, key[0], x, x, "valid"))
                continue
            bad += 1
            fill = last if last is not None and bad <= forward_hours else None
            out.append((ts, key[0], x, fill, "repaired" if fill is not None else "quarantined"))
        state.update((last, bad))
        yield pd.DataFrame(out, columns=["timestamp", "building_id", "original_value", "load", "status"])

    return panel.groupBy("building_id").applyInPandasWithState(step, _OUT, "last double, bad long", "append", GroupStateTimeout.NoTimeout)
