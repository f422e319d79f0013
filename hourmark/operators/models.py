"""Model protocols on Spark ML: who may see what, not which learner.

A model factory is a callable ``seed -> Estimator`` reading a ``features``
vector and a label. Fold loops run over a handful of folds on the driver; every
fit and transform is a distributed job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Factory = Callable[[int], Estimator]


def boosted_trees(label: str, iterations: int = 40, depth: int = 6, loss: str = "squared") -> Factory:
    """Gradient-boosted trees (squared or absolute loss)."""
    return lambda seed: GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="prediction", maxIter=iterations, maxDepth=depth,
        lossType=loss, seed=seed, subsamplingRate=0.8, stepSize=0.1,
    )


def huber_regression(label: str, regularisation: float = 0.01) -> Factory:
    """Linear regression under Huber loss on standardised features."""
    return lambda seed: LinearRegression(
        featuresCol="features", labelCol=label, predictionCol="prediction", loss="huber", regParam=regularisation, maxIter=100
    )


def fit(train: DataFrame, features: Sequence[str], factory: Factory, seed: int = 42, standardise: bool = False) -> PipelineModel:
    """Assemble, optionally standardise on the training rows, and fit.

    Missing lags are filled from training medians; their availability flags are features too.
    """
    filled = [f"_{c}" for c in features]
    stages: list = [Imputer(inputCols=list(features), outputCols=filled, strategy="median")]
    raw = "_raw" if standardise else "features"
    stages.append(VectorAssembler(inputCols=filled, outputCol=raw))
    if standardise:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, factory(seed)]).fit(train)


def predict(model: PipelineModel, rows: DataFrame, out: str = "prediction", low: float | None = None) -> DataFrame:
    keep = [c for c in rows.columns if c != "prediction"]
    value: Column = F.col("prediction")
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return model.transform(rows.select(*keep)).select(*keep, value.alias(out))


def cross_fit(
    df: DataFrame, fold: str, folds: int, features: Sequence[str], factory: Factory, out: str, seed: int = 42, low: float | None = None
) -> DataFrame:
    """Out-of-fold predictions: each row is predicted by a model that never saw its fold."""
    parts = []
    for i in range(folds):
        model = fit(df.filter(F.col(fold) != i), features, factory, seed + i)
        parts.append(predict(model, df.filter(F.col(fold) == i), out, low))
    return reduce(DataFrame.unionByName, parts)


def nested_cross_fit(
    df: DataFrame, fold: str, folds: int, proxy_features: Mapping[str, str], proxy_target: str, extra: Sequence[str], label: str,
    factory: Callable[[str], Factory], seed: int = 42,
) -> DataFrame:
    """Two levels: a proxy learned on actual weather feeds an outer model.

    ``proxy_features`` maps each actual column to its forecast counterpart. For
    outer fold ``i`` the proxy's training values are cross-fitted inside the
    other folds; for the held-out rows the proxy reads forecasts under the
    actual names, as it must when used for real.
    """
    actual = list(proxy_features)
    parts = []
    for i in range(folds):
        train, test = df.filter(F.col(fold) != i), df.filter(F.col(fold) == i)
        inner = []
        for j in range(folds):
            if j == i:
                continue
            proxy = fit(train.filter(F.col(fold) != j), actual, factory(proxy_target), seed + j)
            inner.append(predict(proxy, train.filter(F.col(fold) == j), "oracle_proxy"))
        outer_train = reduce(DataFrame.unionByName, inner)
        full_proxy = fit(train, actual, factory(proxy_target), seed)
        swapped = test.withColumns({a: F.col(f) for a, f in proxy_features.items()})
        outer_test = predict(full_proxy, swapped, "oracle_proxy")
        model = fit(outer_train, [*extra, "oracle_proxy"], factory(label), seed + i)
        parts.append(predict(model, outer_test))
    return reduce(DataFrame.unionByName, parts)


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Feature importance rows (one per feature)."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double")
