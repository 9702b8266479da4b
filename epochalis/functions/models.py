"""Classifiers on MLlib: reducers, pipelines, and validation by groups that are never split."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.statistics import group_folds


def reducer(kind: str, n: int, available: int, label: str):
    """``selectk`` (F test), ``pca`` or ``none``; ``n`` is held to what is available."""
    k = max(1, min(n, available))
    if kind == "selectk":
        return UnivariateFeatureSelector(featuresCol="scaled", outputCol="reduced", labelCol=label, selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    if kind == "pca":
        return PCA(k=k, inputCol="scaled", outputCol="reduced")
    if kind == "none":
        return None
    raise ValueError(f"unknown reducer {kind}")


def pipeline(features: list[str], label: str, reduce_by: str = "selectk", n: int = 8, strength: float = 0.01) -> Pipeline:
    """Constant features go, the others are scaled, reduced and given to a logistic regression."""
    cut = reducer(reduce_by, n, len(features), label)
    steps = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), VarianceThresholdSelector(featuresCol="features", outputCol="varying", varianceThreshold=0.0), StandardScaler(inputCol="varying", outputCol="scaled", withMean=True)]
    return Pipeline(stages=[*steps, *([cut] if cut else []), LogisticRegression(featuresCol="reduced" if cut else "scaled", labelCol=label, regParam=strength, maxIter=50)])


def out_of_fold(rows: DataFrame, features: list[str], label: str, group: str, folds: int = 5, **options) -> DataFrame:
    """``rows`` with ``fold``, ``predicted`` and ``probability``, each row by a model that saw no row of its group.

    Rows with a null feature, label or group go. Folds are no more than groups;
    a group's rows meet its fold by a join with one row a group.
    """
    whole = rows.dropna(subset=[*features, label, group]).withColumn(label, F.col(label).cast("double"))
    held = whole.join(F.broadcast(group_folds(whole, group, label, folds).select(group, "fold")), group)
    used = sorted(r["fold"] for r in held.select("fold").distinct().collect())
    if len(used) < 2:
        raise ValueError("validation by groups needs two groups at least")
    parts = []
    for fold in used:
        model = pipeline(features, label, **options).fit(held.where(F.col("fold") != fold))
        out = model.transform(held.where(F.col("fold") == fold))
        parts.append(out.select(*whole.columns, "fold", F.col("prediction").cast("int").alias("predicted"), F.get(vector_to_array("probability"), F.lit(1)).alias("probability")))
    return reduce(DataFrame.unionByName, parts)
