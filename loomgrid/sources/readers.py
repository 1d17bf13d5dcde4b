"""Readers: meter, metadata and weather files, published conditions, JSON, verified files.

Raw CSV is read as text and cast with ``try_cast``; nothing is inferred. All
paths may be of any file system that Spark opens.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null, no_nan, text_or_null
from ..operators.panel import Selection, join_dimension, resolve, select_entities, wide_to_long
from ..operators.quality import metadata_checks
from ..schemas import CONDITIONS, KEYS, PANEL, WEATHER_COLUMNS


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


#: Fixed value: a time of day that ends in an offset from UTC.
OFFSET = r"\d{2}:\d{2}\S*\s*(Z|z|[+-]\d{2}(:?\d{2})?)$"


def _parsed(c: str):
    """A wall-clock time; text with an offset is turned to UTC, whatever the session's zone."""
    text = F.trim(F.col(f"`{c}`"))
    micros = F.unix_micros(text.try_cast("timestamp")).cast("decimal(18,0)")
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(18,6)"))
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since
    return F.when(text.rlike(OFFSET), utc).otherwise(text.try_cast("timestamp_ntz"))


def header(spark: SparkSession, path: str) -> list[str]:
    """The columns of a file; no data row is read."""
    return _csv(spark, path).columns


def meters(spark: SparkSession, path: str, timestamp_column: str | None = None) -> DataFrame:
    """timestamp, building_id, load from a long or a wide meter file.

    A file with an entity and a load column is long; otherwise every column but
    the time is an entity.
    """
    raw = _csv(spark, path)
    ts = timestamp_column or resolve(raw.columns, "timestamp")
    if ts is None or ts not in raw.columns:
        raise ValueError("the meter file has no timestamp column")
    entity, load = resolve(raw.columns, "building_id"), resolve(raw.columns, "load")
    if entity and load:
        long = raw.select(_parsed(ts).alias("timestamp"), F.col(f"`{entity}`").alias("building_id"), F.col(f"`{load}`").alias("load"))
    else:
        names = [c for c in raw.columns if c != ts]
        if not names:
            raise ValueError("the meter file has no value columns")
        long = wide_to_long(raw.select(_parsed(ts).alias("timestamp"), *[f"`{c}`" for c in names]), ["timestamp"], names)
    return long.select("timestamp", text_or_null(F.col("building_id")).alias("building_id"), no_nan(F.col("load").try_cast("double")).alias("load"))


def selected_wide(spark: SparkSession, path: str, buildings: Sequence[str], timestamp_column: str | None = None, maximum_source_rows: int | None = None) -> DataFrame:
    """Only the chosen entities' columns; the row limit counts source rows, before the reshape."""
    raw = _csv(spark, path)
    ts = timestamp_column or resolve(raw.columns, "timestamp")
    if ts is None:
        raise ValueError("the meter file has no timestamp column")
    rows = raw.select(F.col(f"`{ts}`").alias("_raw_timestamp"), _parsed(ts).alias("timestamp"), *[f"`{b}`" for b in buildings])
    if maximum_source_rows is not None:
        # the first rows by file and place in it, however the files are split
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        rows = rows.select("*", place.alias("place__")).orderBy("place__").limit(maximum_source_rows).drop("place__")
    long = wide_to_long(rows, ["_raw_timestamp", "timestamp"], buildings)
    return long.withColumn("load", no_nan(F.col("load").try_cast("double")))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """building_id, site_id, primary_use, timezone (null if the file has none)."""
    raw = _csv(spark, path)
    found = {c: resolve(raw.columns, c) for c in ("building_id", "site_id", "primary_use", "timezone")}
    if lost := [c for c in ("building_id", "site_id", "primary_use") if not found[c]]:
        raise ValueError(f"the metadata file lacks {lost}")
    return raw.select(*[(text_or_null(F.col(f"`{n}`")) if n else F.lit(None).cast("string")).alias(c) for c, n in found.items()])


def weather(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path)
    if lost := [c for c in ("timestamp", "site_id", *WEATHER_COLUMNS) if c not in raw.columns]:
        raise ValueError(f"the weather file lacks {lost}")
    return raw.select(
        _parsed("timestamp").alias("timestamp"), text_or_null(F.col("site_id")).alias("site_id"),
        *[finite_or_null(F.col(a).try_cast("double")).alias(b) for a, b in WEATHER_COLUMNS.items()],
    )


def ingest(spark: SparkSession, meter_path: str, metadata_path: str, timestamp_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All entities joined to their metadata, and the metadata's issues."""
    meta = metadata(spark, metadata_path)
    return join_dimension(meters(spark, meter_path, timestamp_column), meta), metadata_checks(meta)


def ingest_selected(spark: SparkSession, meter_path: str, metadata_path: str, selection: Selection | None = None, timestamp_column: str | None = None, source_version: str = "v1.0") -> dict[str, Any]:
    """The chosen entities' panel with its issues, selection and exclusions.

    Issues are those of the chosen entities' metadata rows only.
    """
    selection = selection or Selection()
    meta = metadata(spark, metadata_path)
    columns = header(spark, meter_path)
    ts = timestamp_column or resolve(columns, "timestamp")
    chosen, left_out = select_entities(meta, [c for c in columns if c != ts], selection)
    own = meta.where(F.col("building_id").isin(*chosen))
    long = selected_wide(spark, meter_path, chosen, ts, selection.maximum_source_rows)
    panel = join_dimension(long, own).withColumn("source_version", F.lit(source_version))
    return {"panel": panel, "issues": metadata_checks(own), "buildings": chosen, "exclusions": left_out}


def condition(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """A published condition; raises on anything the contract excludes.

    Parquet (a folder, or the folder of one condition in the table of all) or CSV by the file's ending.
    """
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        raw = _csv(spark, path)
        if lost := [f for f in PANEL.fieldNames() if f not in raw.columns and f != "condition"]:
            raise ValueError(f"the condition lacks {lost}")
        named = F.col("condition") if "condition" in raw.columns else F.lit(expected)
        df = raw.select(_parsed("timestamp").alias("timestamp"), text_or_null(F.col("building_id")).alias("building_id"), no_nan(F.col("load").try_cast("double")).alias("load"), "site_id", "primary_use", named.alias("condition"))
    else:
        whole, _, part = path.rstrip("/").rpartition("/")
        reader = spark.read.schema(PANEL)
        df = (reader.option("basePath", whole) if part.startswith("condition=") else reader).parquet(path)
    wrong = F.col("condition").isNull() | ~F.col("condition").isin(*([expected] if expected else CONDITIONS))
    bad = df.agg(F.count_if(F.col("timestamp").isNull()), F.count_if(F.col("building_id").isNull()), F.count_if(wrong)).first()
    for n, what in zip(bad, ("timestamps that cannot be read", "empty building ids", "rows of another condition")):
        if n:
            raise ValueError(f"{path}: {n} {what}")
    if not df.groupBy(*KEYS).count().where("count > 1").isEmpty():
        raise ValueError(f"{path}: keys are not unique")
    unknown = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    return df.select("timestamp", "building_id", "load", unknown("site_id"), unknown("primary_use"), "condition")


def read_json(path: str) -> dict[str, Any]:
    local = Path(path)
    text = local.read_text(encoding="utf-8") if local.exists() else SparkSession.active().read.text(path, wholetext=True).first()[0]
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} does not hold an object")
    return value


def sha256_file(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def verify_file(path: str, expected_size: int | None, expected_sha256: str | None) -> dict[str, Any]:
    """Size and digest of a driver-side file; raises where they are not as expected."""
    size, digest = Path(path).stat().st_size, sha256_file(path)
    if expected_size is not None and size != expected_size:
        raise ValueError(f"{path}: {size} bytes, expected {expected_size}")
    if expected_sha256 is not None and digest != expected_sha256:
        raise ValueError(f"{path}: digest {digest}, expected {expected_sha256}")
    return {"path": path, "size": size, "sha256": digest}


def verify_many(spark: SparkSession, expected: dict[str, str]) -> list[str]:
    """Paths whose content does not have the expected digest, read by executors (any file system)."""
    files = spark.read.format("binaryFile").load(list(expected)).select("path", F.sha2("content", 256).alias("sha256"))
    found = {r["path"].split(":", 1)[-1].lstrip("/"): r["sha256"] for r in files.collect()}
    return [p for p, digest in expected.items() if found.get(p.split(":", 1)[-1].lstrip("/")) != digest]


def download(records: Sequence[dict[str, Any]], target: str, opener: Callable[[str], BinaryIO], force: bool = False) -> list[dict[str, Any]]:
    """Fetch files in parts of 1 MiB to ``.part`` files that are renamed when size and digest are right."""
    out = []
    for r in records:
        path = Path(target, r["name"])
        path.parent.mkdir(parents=True, exist_ok=True)
        if path.exists() and not force:
            out.append(verify_file(str(path), r.get("size"), r.get("sha256")))
            continue
        part, digest, size = path.with_name(path.name + ".part"), hashlib.sha256(), 0
        try:
            with opener(r["url"]) as src, part.open("wb") as dst:
                while block := src.read(1 << 20):
                    dst.write(block)
                    digest.update(block)
                    size += len(block)
            if r.get("size") not in (None, size) or r.get("sha256") not in (None, digest.hexdigest()):
                raise ValueError(f"{r['url']}: size or digest is not as expected")
            part.replace(path)
        finally:
            part.unlink(missing_ok=True)
        out.append({"path": str(path), "size": size, "sha256": digest.hexdigest()})
    return out
