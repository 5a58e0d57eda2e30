"""Persistable model stages of our own: an affine map and a linear 0/1 task.

Both are plain ``pyspark.ml`` transformers with their numbers as parameters (base64 of
float64 values), so they save, load and chain in a ``PipelineModel`` like stock stages.
Rows go through them in Arrow batches, one matrix product a batch.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encoded(values: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(values, np.float64).tobytes()).decode("ascii")


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.float64)


class AffineModel(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``outputCol`` = matrix · (the input vectors one after the other) + shift."""

    matrix = Param(Params._dummy(), "matrix", "base64 of the matrix's rows", TypeConverters.toString)
    shift = Param(Params._dummy(), "shift", "base64 of the shift", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, matrix=None, shift=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def of(input_cols: list[str], output_col: str, matrix: np.ndarray, shift: np.ndarray) -> AffineModel:
        return AffineModel(inputCols=input_cols, outputCol=output_col, matrix=encoded(matrix), shift=encoded(shift))

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        shift = decoded(self.getOrDefault(self.shift))
        return decoded(self.getOrDefault(self.matrix)).reshape(len(shift), -1), shift

    def _transform(self, df: DataFrame) -> DataFrame:
        matrix, shift = self.numbers()

        @F.pandas_udf("array<double>")
        def apply(rows: pd.Series) -> pd.Series:
            x = np.vstack(rows.to_numpy()) if len(rows) else np.zeros((0, matrix.shape[1]))
            return pd.Series(list(x @ matrix.T + shift))
        raw = F.concat(*[vector_to_array(c) for c in self.getInputCols()])
        return df.withColumn(self.getOutputCol(), array_to_vector(apply(raw)))


class LinearTaskModel(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """``predictionCol`` = 1.0 where coefficients · features + intercept > 0, else 0.0."""

    weights = Param(Params._dummy(), "weights", "base64 of the coefficients", TypeConverters.toString)
    intercept_ = Param(Params._dummy(), "intercept_", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", weights=None, intercept_=0.0):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def of(features_col: str, prediction_col: str, weights: np.ndarray, intercept: float) -> LinearTaskModel:
        return LinearTaskModel(featuresCol=features_col, predictionCol=prediction_col, weights=encoded(weights),
                               intercept_=float(intercept))

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(decoded(self.getOrDefault(self.weights)))

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.intercept_)

    def _transform(self, df: DataFrame) -> DataFrame:
        w, b = decoded(self.getOrDefault(self.weights)), self.intercept

        @F.pandas_udf("double")
        def vote(rows: pd.Series) -> pd.Series:
            x = np.vstack(rows.to_numpy()) if len(rows) else np.zeros((0, len(w)))
            return pd.Series((x @ w + b > 0).astype(float))
        return df.withColumn(self.getPredictionCol(), vote(vector_to_array(self.getFeaturesCol())))
