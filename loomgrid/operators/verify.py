"""Verification as joins and counts: parity, documented changes, key sets, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import close, flag
from ..schemas import KEYS


def parity(reference: DataFrame, candidate: DataFrame, cutoff: str, exact: bool = False) -> DataFrame:
    """Rows at or after the cutoff whose readings differ."""
    a = reference.select(*KEYS, F.col("load").alias("reference_load"))
    b = candidate.select(*KEYS, F.col("load").alias("candidate_load"))
    x, y = F.col("candidate_load"), F.col("reference_load")
    same = x.eqNullSafe(y) if exact else close(x, y)
    return a.join(b, KEYS).where((F.col("timestamp") >= F.lit(cutoff).cast("timestamp_ntz")) & ~same)


def changed_keys(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    a = reference.select(*KEYS, F.col("load").alias("reference_load"))
    b = candidate.select(*KEYS, F.col("load").alias("candidate_load"))
    return a.join(b, KEYS).where(~close(F.col("candidate_load"), F.col("reference_load"))).select(*KEYS)


def documented_changes(reference: DataFrame, corrupted: DataFrame, faults: DataFrame) -> DataFrame:
    """timestamp, building_id, kind: undocumented changes and documented ones without effect."""
    changed, told = changed_keys(reference, corrupted), faults.select(*KEYS).distinct()
    return changed.join(told, KEYS, "left_anti").withColumn("kind", F.lit("undocumented")).unionByName(
        told.join(changed, KEYS, "left_anti").withColumn("kind", F.lit("ineffective"))
    )


def footprint(corrupted: DataFrame, remediated: DataFrame, faults: DataFrame) -> DataFrame:
    """Keys that the repair changed although no fault was injected there."""
    return changed_keys(corrupted, remediated).join(faults.select(*KEYS).distinct(), KEYS, "left_anti")


def unlogged(corrupted: DataFrame, remediated: DataFrame, log: DataFrame) -> DataFrame:
    """Keys that the repair changed although its log does not name them with the two values."""
    told = log.select(*KEYS, F.col("original_value").alias("a"), F.col("remediated_value").alias("b"), F.lit(True).alias("told"))
    x = corrupted.select(*KEYS, F.col("load").alias("x"))
    y = remediated.select(*KEYS, F.col("load").alias("y"))
    both = x.join(y, KEYS).where(~close(F.col("y"), F.col("x"))).join(told, KEYS, "left")
    return both.where(~(flag(F.col("told")) & close(F.col("x"), F.col("a")) & close(F.col("y"), F.col("b")))).select(*KEYS)


def bind_faults(faults: DataFrame, reference: DataFrame, corrupted: DataFrame) -> DataFrame:
    """Fault rows whose recorded values are not those of the two panels (or whose key is not there)."""
    a = reference.select(*KEYS, F.col("load").alias("reference_load"), F.lit(True).alias("in_reference"))
    b = corrupted.select(*KEYS, F.col("load").alias("corrupted_load"))
    joined = faults.join(a, KEYS, "left").join(b, KEYS, "left")
    ok = flag(F.col("in_reference")) & close(F.col("original_value"), F.col("reference_load")) & close(F.col("corrupted_value"), F.col("corrupted_load"))
    return joined.where(~ok).select(*faults.columns)


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys with their number of surplus rows on each side; empty if both have the same multiset."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    left, right = count(a, "na"), count(b, "nb").select(*[F.col(k).alias(f"{k}__") for k in keys], "nb")
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"{k}__"))
        on = c if on is None else on & c
    both = left.join(right, on, "full_outer").where("coalesce(na, 0) <> coalesce(nb, 0)")
    return both.select(*[F.coalesce(k, f"{k}__").alias(k) for k in keys], F.coalesce("na", F.lit(0)).alias("left_rows"), F.coalesce("nb", F.lit(0)).alias("right_rows"))


def attribute_difference(a: DataFrame, b: DataFrame, columns: Sequence[str] = ("site_id", "primary_use")) -> DataFrame:
    other = b.select(*KEYS, *[F.col(c).alias(f"{c}__") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    return a.join(other, KEYS).where(~same).select(*KEYS)


def unbound_predictions(predictions: DataFrame, reference: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Predictions whose target is not the reference reading of their key."""
    truth = reference.select(*keys, F.col("load").alias("truth__"), F.lit(True).alias("known__"))
    joined = predictions.join(truth, list(keys), "left")
    return joined.where(~(flag(F.col("known__")) & close(F.col("target"), F.col("truth__")))).select(*predictions.columns)


def prediction_contract(predictions: DataFrame, pairs: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys with a wrong number of predictions or more than one target."""
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("condition", "model").alias("pairs"), F.count_distinct("target").alias("targets")
    ).where((F.col("rows") != pairs) | (F.col("pairs") != pairs) | (F.col("targets") != 1))


def incomplete_vectors(predictions: DataFrame, horizons: int = 24) -> DataFrame:
    """Vectors whose horizons are not exactly 1..n."""
    expected = F.sequence(F.lit(1), F.lit(horizons))
    got = predictions.groupBy("forecast_origin", "building_id", "condition", "model").agg(F.array_sort(F.collect_list(F.col("horizon_hours").cast("int"))).alias("h"))
    return got.where(~F.col("h").eqNullSafe(expected)).drop("h")


def table_difference(observed: DataFrame, expected: DataFrame, keys: Sequence[str], rtol: float = 1e-9, atol: float = 1e-9) -> DataFrame:
    """Rows of a stored result table that a recomputation does not reproduce."""
    values = [c for c in expected.columns if c not in keys]
    types = dict(expected.dtypes)
    right = expected.select(*[F.col(k).alias(f"{k}__") for k in keys], *[F.col(v).alias(f"{v}__") for v in values], F.lit(True).alias("in_expected"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__"))
    both = observed.withColumn("in_observed", F.lit(True)).join(right, on, "full_outer")
    ok = flag(F.col("in_expected")) & flag(F.col("in_observed"))
    for v in values:
        a, b = F.col(v), F.col(f"{v}__")
        ok = ok & (close(a.cast("double"), b.cast("double"), rtol, atol) if types[v] in ("double", "float") else a.eqNullSafe(b))
    return both.where(~ok).select(*[F.coalesce(k, f"{k}__").alias(k) for k in keys])


def content_digest(df: DataFrame) -> str:
    """A digest of the rows that does not depend on their order, files or partitions.

    Row digests add up in four 64-bit lanes by XOR and, since equal rows cancel
    there, by a sum of 32-bit halves; one aggregation, no sort.
    """
    columns = sorted(df.columns)
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]))
    row = F.sha2(text, 256)
    lane = lambda i: F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
    totals = df.select(row.alias("r"), *[lane(i).alias(f"l{i}") for i in range(8)]).agg(
        F.count(F.lit(1)), *[F.sum(f"l{i}") for i in range(8)]
    ).first()
    import hashlib

    return hashlib.sha256(("|".join(columns) + "|" + "|".join(str(v) for v in totals)).encode()).hexdigest()
