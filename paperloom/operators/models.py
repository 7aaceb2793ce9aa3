"""Learned candidate scores and document types: Spark ML pipelines, split by hash, calibrated over hash folds."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(df: DataFrame, key: str, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, test): one fold of the key's hash is the test."""
    fold = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folds))
    return df.filter(fold != 0), df.filter(fold == 0)


def balanced(df: DataFrame, label: str = "label", count: str | None = None) -> DataFrame:
    """A weight for each row so that the labels weigh the same; a row stands for as many as its `count`."""
    n = {r[0]: r[1] for r in df.groupBy(label).agg(F.sum(count) if count else F.count("*")).collect()}
    total, out = sum(n.values()), F.lit(0.0)
    for v, c in n.items():
        out = F.when(F.col(label) == v, total / (len(n) * c)).otherwise(out)
    return df.withColumn("weight", out * F.col(count) if count else out)


def fit(df: DataFrame, features, label: str = "label", weight: str | None = None):
    """Scaled logistic regression."""
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=50, regParam=1e-3)
    if weight:
        lr = lr.setWeightCol(weight)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), lr]).fit(df)
    # the training summary holds the session, which can't be sent to tasks once anything was observed in it
    model.stages[-1]._java_obj.setSummary(df.sparkSession._jvm.scala.Option.empty())
    return model


def probabilities(model, df: DataFrame, name: str = "p") -> DataFrame:
    """Adds the array of class probabilities."""
    return model.transform(df).withColumn(name, vector_to_array("probability")).drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def fit_calibrated(df: DataFrame, features, key: str, folds: int = 3, count: str | None = None):
    """[(model, calibrator)] by hash fold: each model is fitted without its fold, its margin calibrated by a logistic curve on it. A row stands for as many as its `count`."""
    out, fold = [], F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folds))
    margin = F.get(vector_to_array("rawPrediction"), 1)
    for k in range(folds):
        model = fit(balanced(df.filter(fold != k), count=count), features, weight="weight")
        held = model.transform(df.filter(fold == k)).select(margin.alias("margin"), "label", *([count] if count else []))
        logistic = LogisticRegression(featuresCol="m", labelCol="label", maxIter=50)
        curve = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="m"), logistic.setWeightCol(count) if count else logistic]).fit(held)
        out.append((model, curve.stages[-1].coefficients[0], curve.stages[-1].intercept))
    return out


def score_calibrated(models, df: DataFrame, name: str = "p") -> DataFrame:
    """Mean of the calibrated probabilities of class 1, over the folds' models."""
    p = F.lit(0.0)
    for k, (model, slope, shift) in enumerate(models):
        df = model.transform(df).withColumn(f"_p{k}", 1 / (1 + F.exp(-(slope * F.get(vector_to_array("rawPrediction"), 1) + shift)))).drop("raw", "scaled", "rawPrediction", "probability", "prediction")
        p = p + F.col(f"_p{k}")
    return df.withColumn(name, p / len(models)).drop(*[f"_p{k}" for k in range(len(models))])
