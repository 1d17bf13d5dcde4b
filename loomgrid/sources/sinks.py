"""Sinks: condition tables, CSV exports, canonical JSON, manifests, blocked runs."""

from __future__ import annotations

import gzip
import json
import math
import os
from collections.abc import Sequence
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.verify import content_digest


def json_value(v: Any) -> Any:
    """Strict JSON: NaN and infinities become null, times ISO text."""
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, dict):
        return {str(k): json_value(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [json_value(x) for x in v]
    return v.item() if hasattr(v, "item") else v


def canonical_json(value: Any) -> bytes:
    return (json.dumps(json_value(value), sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":")) + "\n").encode()


def _store(path: str):
    """Hadoop's file system for a path and its path there, as Spark's own writers find them; None without a session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def write_text(path: str, text: str) -> None:
    """Written aside and renamed, in the store that holds the tables beside it."""
    found = _store(path)
    if found is None:
        aside = Path(f"{path}.tmp")
        aside.parent.mkdir(parents=True, exist_ok=True)
        aside.write_text(text, encoding="utf-8")
        os.replace(aside, path)
        return
    files, target = found
    aside = target.suffix(".tmp")
    out = files.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    files.delete(target, False)
    if not files.rename(aside, target):
        raise OSError(f"{path} could not be written")


def write_json(path: str, value: Any) -> None:
    """Sorted keys, written aside and renamed."""
    write_text(path, json.dumps(json_value(value), sort_keys=True, indent=2, allow_nan=False) + "\n")


def write_conditions(conditions: DataFrame, path: str) -> None:
    """All conditions as one Parquet table, a folder for each; refuses to overwrite."""
    order = ["condition", "timestamp", "building_id"]
    sorted_files = conditions.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_files.write.mode("errorifexists").partitionBy("condition").parquet(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), compression: str | None = "gzip") -> None:
    """A folder of CSV files, compressed where asked; with an order, sorted over the files' names."""
    rows = df.orderBy(*[F.asc_nulls_first(c) for c in order]) if order else df
    rows.write.mode("errorifexists").option("header", True).option("compression", compression or "none").csv(path)


def export_csv_gz(df: DataFrame, path: str, order: list[str]) -> None:
    """One sorted gzip file without time stamps in its head; for small result tables."""
    rows = df.orderBy(*[F.asc_nulls_first(c) for c in order])
    aside = Path(f"{path}.tmp")
    aside.parent.mkdir(parents=True, exist_ok=True)
    with aside.open("wb") as raw, gzip.GzipFile(filename="", mode="wb", fileobj=raw, compresslevel=9, mtime=0) as out:
        out.write((",".join(df.columns) + "\n").encode())
        for r in rows.toLocalIterator():
            cells = ["" if json_value(v) is None else str(json_value(v)) for v in r]
            out.write((",".join(f'"{c}"' if "," in c or '"' in c else c for c in cells) + "\n").encode())
    os.replace(aside, path)


def manifest_entry(df: DataFrame, path: str) -> dict[str, Any]:
    return {"path": path, "rows": df.count(), "columns": df.columns, "content_sha256": content_digest(df)}


def empty_target(path: str) -> None:
    """Makes the folder; raises where something is in it."""
    found = _store(path)
    if found is None:
        target = Path(path)
        filled = target.exists() and any(target.iterdir())
        target.mkdir(parents=True, exist_ok=True)
    else:
        files, target = found
        filled = files.exists(target) and len(files.listStatus(target)) > 0
        files.mkdirs(target)
    if filled:
        raise FileExistsError(f"{path} is not empty")


def write_blocked(path: str, reason: str, message: str, issues: DataFrame | None = None) -> None:
    """What a blocked run leaves behind: the reason and the issues, no condition files."""
    write_json(f"{path}/blocked_run.json", {"status": "blocked", "reason_code": reason, "message": message})
    if issues is not None:
        issues.withColumn("sample", F.to_json("sample")).write.mode("errorifexists").json(f"{path}/blocked_issues")
