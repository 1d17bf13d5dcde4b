"""Bootstrap intervals.

Block intervals resample blocks (entity and ISO week): Spark first folds the
rows to a sum and a count a block, and only these go to the resampling. Row
intervals resample the rows of a group. Groups too large for one worker's
memory use the Poisson form, which weights each row independently in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.025, 0.975)


def row_interval(values: np.ndarray, repetitions: int, seed: int, by_index: bool) -> tuple[float, float]:
    """by_index: draw indexes (paired differences); else draw values (absolute errors)."""
    values = values[np.isfinite(values)]
    if not values.size:
        return float("nan"), float("nan")
    if repetitions <= 1:
        return (float(values.mean()),) * 2
    rng, n = np.random.default_rng(seed), values.size
    draw = (lambda: values[rng.integers(0, n, size=n)]) if by_index else (lambda: rng.choice(values, size=n, replace=True))
    low, high = np.quantile([draw().mean() for _ in range(repetitions)], QUANTILES)
    return float(low), float(high)


def block_interval(sums: np.ndarray, counts: np.ndarray, repetitions: int, seed: int) -> tuple[float, float]:
    """sums and counts stand in the order of the sorted block ids."""
    if not len(sums):
        return float("nan"), float("nan")
    if repetitions <= 1:
        return (float(sums.sum() / counts.sum()),) * 2
    rng, n = np.random.default_rng(seed), len(sums)
    means = []
    for _ in range(repetitions):
        at = rng.integers(0, n, size=n)
        means.append(sums[at].sum() / counts[at].sum())
    low, high = np.quantile(means, QUANTILES)
    return float(low), float(high)


def block_sums(rows: DataFrame, value: str, block: str, by: Sequence[str]) -> DataFrame:
    return rows.where(~F.isnan(value) & F.col(value).isNotNull()).groupBy(*by, F.col(block).alias("block")).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")
    )


def _schema(df: DataFrame, by: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"{c} {types[c]}" for c in by), "ci_low double", "ci_high double"])


def block_bootstrap(rows: DataFrame, value: str, block: str, by: Sequence[str], repetitions: int, seed: int, seed_by: str | None = None) -> DataFrame:
    """Percentile interval of the row-weighted mean for each group; ``seed_by`` adds a group column to the seed."""
    folded = block_sums(rows, value, block, by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        own = seed + (int(pdf[seed_by].iloc[0]) if seed_by else 0)
        low, high = block_interval(pdf["total"].to_numpy(float), pdf["n"].to_numpy(float), repetitions, own)
        return pd.DataFrame([[*pdf[list(by)].iloc[0], low, high]], columns=[*by, "ci_low", "ci_high"])

    return folded.groupBy(*by).applyInPandas(run, _schema(folded, by))


def row_bootstrap(rows: DataFrame, value: str, by: Sequence[str], order: Sequence[str], repetitions: int, seed: int, by_index: bool = False) -> DataFrame:
    """Percentile interval of the mean; rows are resampled in the given order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        low, high = row_interval(pdf[value].to_numpy(float), repetitions, seed, by_index)
        return pd.DataFrame([[*pdf[list(by)].iloc[0], low, high]], columns=[*by, "ci_low", "ci_high"])

    kept = rows.select(*dict.fromkeys([*by, *order, value]))
    return kept.groupBy(*by).applyInPandas(run, _schema(kept, by))


def poisson_bootstrap(rows: DataFrame, value: str, by: Sequence[str], order: Sequence[str], repetitions: int, seed: int) -> DataFrame:
    """The same interval without gathering a group: Poisson(1) weights from a hash of row and repetition.

    Map-side partial sums leave one row a group, repetition and task.
    """
    u = F.pmod(F.xxhash64(*order, "rep", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    weight, tail, term = F.lit(0), 0.0, float(np.exp(-1))
    for k in range(1, 12):
        tail += term
        weight = weight + (u >= tail).cast("int")
        term /= k
    means = (
        rows.where(~F.isnan(value) & F.col(value).isNotNull())
        .withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
        .withColumn("w", weight)
        .groupBy(*by, "rep").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0).cast("long"))).alias("m"))
    )
    return means.groupBy(*by).agg(F.percentile("m", F.lit(QUANTILES[0])).alias("ci_low"), F.percentile("m", F.lit(QUANTILES[1])).alias("ci_high"))
