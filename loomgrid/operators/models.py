"""Forecast models on MLlib: preprocessing fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null
from .features import CATEGORICAL, seasonal_naive
from .quantiles import exact_medians

MODELS = ("seasonal_naive", "hist_gradient_boosting", "random_forest", "ridge")


@dataclass(frozen=True)
class ModelConfig:
    seed: int = 42
    max_iter: int = 120
    learning_rate: float = 0.07
    max_depth: int = 5
    n_trees: int = 200
    min_leaf: int = 5
    max_features: float = 0.5
    forest_depth: int = 30  # MLlib's limit; the reference has none
    ridge_alpha: float = 1.0


class Preprocessor:
    """Exact medians with missing marks, modes and one-hot, and (for ridge) population scaling."""

    def __init__(self, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool):
        self.numeric, self.categorical = list(numeric), list(categorical)
        values = {c: finite_or_null(F.col(c).cast("double")) for c in self.numeric}
        stats = train.agg(
            *[F.count_if(values[c].isNull()).alias(f"{c}__n") for c in self.numeric],
            *[F.mode(F.col(c), deterministic=True).alias(f"{c}__mode") for c in self.categorical],
        ).first()
        self.medians = {c: m for c, m in exact_medians(train, values).items() if m is not None}
        self.numeric = list(self.medians)
        self.marked = [c for c in self.numeric if stats[f"{c}__n"]]
        self.modes = {c: stats[f"{c}__mode"] for c in self.categorical}
        self.scaling: dict[str, tuple[float, float]] = {}
        names = [*self.numeric, *[f"{c}__missing" for c in self.marked]]
        if scale:
            filled = self._fill(train)
            s = filled.agg(*[x for c in names for x in (F.avg(c).alias(f"{c}__a"), F.stddev_pop(c).alias(f"{c}__s"))]).first()
            self.scaling = {c: (s[f"{c}__a"] or 0.0, s[f"{c}__s"] or 1.0) for c in names}
        filled = self._fill(train)
        index = StringIndexer(inputCols=self.categorical, outputCols=[f"{c}__i" for c in self.categorical], handleInvalid="keep").fit(filled)
        encode = OneHotEncoder(inputCols=[f"{c}__i" for c in self.categorical], outputCols=[f"{c}__h" for c in self.categorical], dropLast=True).fit(index.transform(filled))
        join = VectorAssembler(inputCols=[*names, *[f"{c}__h" for c in self.categorical]], outputCol="features__")
        self.steps: list[Model | VectorAssembler] = [index, encode, join]

    def _fill(self, df: DataFrame) -> DataFrame:
        value = {c: finite_or_null(F.col(c).cast("double")) for c in self.numeric}
        marks = {f"{c}__missing": value[c].isNull().cast("double") for c in self.marked}
        df = df.withColumns(marks) if marks else df
        df = df.withColumns({c: F.coalesce(value[c], F.lit(self.medians[c])) for c in self.numeric})
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(self.modes[c])) for c in self.categorical})
        if self.scaling:
            df = df.withColumns({c: (F.col(c) - a) / s for c, (a, s) in self.scaling.items()})
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        df = self._fill(df)
        for step in self.steps:
            df = step.transform(df)
        return df


def estimator(name: str, config: ModelConfig, rows: int, target_sd: float):
    common = {"featuresCol": "features__", "labelCol": "target__", "predictionCol": "prediction"}
    if name == "hist_gradient_boosting":
        return GBTRegressor(maxIter=config.max_iter, stepSize=config.learning_rate, maxDepth=config.max_depth, maxBins=255, seed=config.seed, **common)
    if name == "random_forest":
        return RandomForestRegressor(
            numTrees=config.n_trees, minInstancesPerNode=config.min_leaf, featureSubsetStrategy=str(config.max_features),
            maxDepth=config.forest_depth, seed=config.seed, **common,
        )
    if name == "ridge":
        # MLlib divides the penalty by the target's standard deviation
        penalty = config.ridge_alpha / max(rows, 1) * (target_sd or 1.0)
        return LinearRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, solver="l-bfgs", maxIter=500, tol=1e-12, **common)
    raise ValueError(f"model is one of {MODELS}")


def fit_predict(train: DataFrame, test: DataFrame, name: str, config: ModelConfig, numeric: Sequence[str], *, target: str = "load", categorical: Sequence[str] = CATEGORICAL, keys: Sequence[str] = ("timestamp", "building_id", "site_id", "primary_use")) -> DataFrame:
    """keys, prediction for the test rows."""
    if name == "seasonal_naive":
        return test.select(*keys, seasonal_naive(test).alias("prediction"))
    usable = train.where(finite_or_null(F.col(target)).isNotNull()).withColumn("target__", F.col(target).cast("double"))
    prepared = Preprocessor(usable, numeric, categorical, scale=name == "ridge")
    n, sd = usable.agg(F.count(F.lit(1)), F.stddev_samp("target__")).first()
    if not n:
        raise ValueError("no finite training targets")
    model = estimator(name, config, n, sd).fit(prepared.transform(usable).select("features__", "target__"))
    tagged = test.withColumns({f"key__{i}": F.col(k) for i, k in enumerate(keys)})
    scored = model.transform(prepared.transform(tagged))
    return scored.select(*[F.col(f"key__{i}").alias(k) for i, k in enumerate(keys)], "prediction")
