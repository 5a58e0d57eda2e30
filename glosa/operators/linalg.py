"""Standardisation and decomposition (M1, M2) with Spark ML building blocks.

* ``fit_population_scaler``: (x − mean) / population std, the scaler the
  reference uses. Spark's ``StandardScaler`` divides by the sample std, so the
  fitted model here is a ``StandardScalerModel`` that only centres, followed by
  an ``ElementwiseProduct`` with 1 / population std (a zero-variance column
  keeps scale 1). Both stages are stock Spark ML and persist with the pipeline.
* ``fit_svd``: truncated SVD of standardised (train-centred) data equals PCA
  projection ``X·V`` up to sign; ``pyspark.ml.feature.PCA`` computes it from a
  d×d covariance aggregated across executors. A trial's k is a prefix of the
  components (``VectorSlicer``), so one fit per fold serves every trial.
* ``gram``: second-moment matrix ``XᵀX / n`` as a long table; each partition
  builds its partial d×d sum with NumPy and a grouped sum adds the partials.
"""

from __future__ import annotations

import math
import threading

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorSlicer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_population_scaler(df: DataFrame, input_col: str, output_col: str) -> PipelineModel:
    centred = f"{output_col}__centred"
    ssm = StandardScaler(inputCol=input_col, outputCol=centred, withMean=True, withStd=False).fit(df)
    n = df.where(F.col(input_col).isNotNull()).count()
    factor = math.sqrt((n - 1) / n) if n > 1 else 1.0
    std_pop = ssm.std.toArray() * factor
    scale = np.where(std_pop > 0, 1.0 / np.where(std_pop > 0, std_pop, 1.0), 1.0)
    prod = ElementwiseProduct(inputCol=centred, outputCol=output_col, scalingVec=Vectors.dense(scale))
    return PipelineModel(stages=[ssm, prod])


def drop_cols(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


_DECOMPOSE = threading.Lock()


def fit_svd(df: DataFrame, input_col: str, output_col: str, k: int) -> PipelineModel:
    """M2: projection on the first ``k`` right singular vectors of centred data.

    The covariance is aggregated by the executors; its d×d decomposition runs on
    the driver, one at a time (the native solver is not safe to call from
    concurrent fold threads)."""
    with _DECOMPOSE:
        return PipelineModel(stages=[PCA(k=k, inputCol=input_col, outputCol=output_col).fit(df)])


def prefix_slicer(input_col: str, output_col: str, k: int) -> VectorSlicer:
    return VectorSlicer(inputCol=input_col, outputCol=output_col, indices=list(range(k)))


def gram(df: DataFrame, array_col: str, dim: int, fan_in: int = 64) -> DataFrame:
    """``(i, j, value)`` of ``XᵀX / n`` over an ``array<double>`` column.

    Each task adds its rows into one d×d partial with NumPy, which travels as
    ``d`` rows of ``d`` values. Partials are added up in two steps, by ``i`` and
    one of ``fan_in`` parts at first, so that no sum reads the rows of all tasks;
    a lost task redoes its own input only."""
    src = df.select(array_col)

    def partial(batches):
        acc = np.zeros((dim, dim))
        n = 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[array_col].to_numpy()).astype(np.float64)
                acc += x.T @ x
                n += len(x)
        yield pd.DataFrame({"i": np.arange(dim, dtype=np.int32), "row": list(acc),
                            "n": np.full(dim, n, dtype=np.int64)})

    parts = src.mapInPandas(partial, "i int, row array<double>, n long")
    total = [F.array(*[F.sum(F.col("row")[j]) for j in range(dim)]).alias("row"), F.sum("n").alias("n")]
    summed = (parts.groupBy("i", F.pmod(F.spark_partition_id(), F.lit(fan_in)).alias("part")).agg(*total)
              .groupBy("i").agg(*total))
    return summed.select("i", F.posexplode("row").alias("j", "s"), "n").select(
        "i", "j", (F.col("s") / F.col("n")).alias("value"))
