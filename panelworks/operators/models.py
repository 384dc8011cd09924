"""Model training and scoring on Spark ML; every function returns a DataFrame or a fitted model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.functions.scalars import above
from panelworks.operators.split import with_class_weights
from panelworks.session import fresh_path


def feature_array(columns: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in columns])


def _ready(df: DataFrame, v: str) -> DataFrame:
    """``v`` is an array of doubles, or a vector already."""
    is_vector = isinstance(df.schema[v].dataType, VectorUDT)
    return df.withColumn("features", F.col(v) if is_vector else array_to_vector(v))


def stored(model, spark, label: str = "model"):
    """The model saved under the shared folder and loaded from it, as a later session would."""
    path = fresh_path(spark, label)
    model.write().save(path)
    return type(model).load(path)


def fit_forest(
    df: DataFrame, v: str, label: str, trees: int = 125, depth: int = 8, per_split: str = "50",
    min_leaf: int = 5, seed: int = 9005,
):
    """Random forest with balanced class weights."""
    rf = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy=per_split, minInstancesPerNode=min_leaf,
        seed=seed, labelCol=label, weightCol="weight")
    return rf.fit(_ready(with_class_weights(df, label), v))


def fit_logistic(df: DataFrame, v: str, label: str, reg: float = 0.01):
    """Sigmoid output and log loss with balanced class weights."""
    lr = LogisticRegression(labelCol=label, weightCol="weight", regParam=reg, maxIter=50)
    return lr.fit(_ready(with_class_weights(df, label), v))


def fit_boosted(df: DataFrame, v: str, target: str, rounds: int = 100, depth: int = 3, seed: int = 1):
    return GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed).fit(_ready(df, v))


def score(model, df: DataFrame, v: str) -> DataFrame:
    """Probability ``p`` of class 1 and class ``cls`` (> 0.5)."""
    out = model.transform(_ready(df, v)).withColumn("p", vector_to_array("probability")[1])
    return out.withColumn("cls", above("p", 0.5)).select(*df.columns, "p", "cls")


def predict(model, df: DataFrame, v: str) -> DataFrame:
    return model.transform(_ready(df, v)).select(*df.columns, "prediction")


def cross_validate(df: DataFrame, fold: str, folds: int, fit: Callable[[DataFrame], object], v: str) -> DataFrame:
    """Pooled out-of-fold scores; ``df`` should be a stored table, each fold reads it again."""
    parts = [
        score(fit(df.filter(F.col(fold) != i)), df.filter(F.col(fold) == i), v) for i in range(folds)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
