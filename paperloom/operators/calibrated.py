"""A calibrated classifier as a Spark ML estimator: it fits in a Pipeline, and its model can be saved and loaded."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models


class _Shared(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol):
    keyCol = Param(Params._dummy(), "keyCol", "rows that share a key fall into one fold", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "models that are fitted, each calibrated on the fold that it hasn't seen", TypeConverters.toInt)
    threshold = Param(Params._dummy(), "threshold", "least probability of a prediction of 1", TypeConverters.toFloat)

    def _defaults(self):
        self._setDefault(featuresCol="features", labelCol="label", probabilityCol="probability", predictionCol="prediction", folds=3, threshold=0.5)


class CalibratedClassifier(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Scaled logistic regressions with balanced labels 0 and 1, by hash fold of keyCol; each one's margin is calibrated by a logistic curve on its fold, and the probability is their mean. A row counts as often as weightCol says."""

    @keyword_only
    def __init__(self, *, keyCol=None, featuresCol="features", labelCol="label", probabilityCol="probability", predictionCol="prediction", folds=3, threshold=0.5, weightCol=None):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CalibratedModel:
        features, label = self.getOrDefault("featuresCol"), self.getOrDefault("labelCol")
        count = ["n"] if self.isDefined("weightCol") else []
        rows = df.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label"), F.col(self.getOrDefault("keyCol")).alias("key"), *[F.col(self.getOrDefault("weightCol")).alias(c) for c in count])
        fitted = models.fit_calibrated(rows, ["features"], "key", self.getOrDefault("folds"), *count)
        out = CalibratedModel([m for m, _, _ in fitted], [(float(a), float(b)) for _, a, b in fitted])
        return self._copyValues(out)


class CalibratedModel(Model, _Shared, MLWritable, MLReadable):
    """Adds the probability of class 1 and the prediction."""

    def __init__(self, fitted: list[PipelineModel] = (), curves: list[tuple[float, float]] = ()):
        super().__init__()
        self._defaults()
        self.fitted, self.curves = list(fitted), list(curves)

    def _transform(self, df: DataFrame) -> DataFrame:
        features, name = self.getOrDefault("featuresCol"), self.getOrDefault("probabilityCol")
        p = F.lit(0.0)
        out = df.withColumn("__kept", F.struct(*df.columns)).select(F.col(features).alias("features"), "__kept")
        for k, (model, (slope, shift)) in enumerate(zip(self.fitted, self.curves)):
            margin = F.get(vector_to_array("rawPrediction"), 1)
            out = model.transform(out).withColumn(f"__p{k}", 1 / (1 + F.exp(-(slope * margin + shift)))).drop("raw", "scaled", "rawPrediction", "probability", "prediction")
            p = p + F.col(f"__p{k}")
        out = out.withColumn("__p", p / len(self.fitted))
        prediction = (F.col("__p") >= self.getOrDefault("threshold")).cast("double")
        return out.select(*[F.col(f"__kept.`{c}`").alias(c) for c in df.columns], F.col("__p").alias(name), prediction.alias(self.getOrDefault("predictionCol")))

    def margins(self) -> tuple[np.ndarray, np.ndarray]:
        """The calibrated margins as sums: weights of the features (a row each) by fold, and what is added; the probability is the mean of their logistic values."""
        weights, shifts = [], []
        for model, (slope, shift) in zip(self.fitted, self.curves):
            scaler, logistic = model.stages[-2:]
            std = scaler.std.toArray()
            w = np.divide(logistic.coefficients.toArray(), std, out=np.zeros(len(std)), where=std > 0)
            weights.append(slope * w)
            shifts.append(slope * (logistic.intercept - scaler.mean.toArray() @ w) + shift)
        return np.column_stack(weights), np.array(shifts)

    def copy(self, extra=None) -> CalibratedModel:
        out = super().copy(extra)
        out.fitted, out.curves = list(self.fitted), list(self.curves)
        return out

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: CalibratedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"curves": self.model.curves})
        for k, m in enumerate(self.model.fitted):
            m.write().overwrite().save(f"{path}/fold{k}")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CalibratedModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        curves = [tuple(c) for c in meta["curves"]]
        out = self.cls([PipelineModel.load(f"{path}/fold{k}") for k in range(len(curves))], curves)
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out
