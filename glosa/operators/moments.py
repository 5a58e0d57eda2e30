"""Sufficient statistics of all folds in one scan (M1, M2, M4).

Every task adds its rows, less a common shift and with a 1 at their end, into one
matrix of products per fold; sums over tasks give, for each fold, its rows' number,
sums and products. A training fold is the total less its own part, so means,
population variances and covariances of all folds come from one pass, and with them
the scaler, the SVD of the scaled block and the scaler of the union: d x d work on
the driver, whatever the number of rows.

The shift is the mean of the first rows that a task has. It only keeps the sums
small, so that nothing is lost when squares are subtracted; any value is right.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT_ROWS = 1000
DRIVER_BYTES = 64 * 1024 * 1024
NOISE = 1e-13  # of a column's second moment: less is no variance


def batch_matrix(column: pa.Array) -> np.ndarray:
    """An ``array<double>`` column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed_rows(parts: DataFrame, keys: Sequence[str], n_parts: int, part_bytes: int, fan_in: int = 64) -> list:
    """Sums of the arrays ``row`` by ``keys``, as (*keys, array) tuples on the driver.

    Partials travel to the driver as they are while all of them are small; beyond that
    they are added up by the executors, in two steps, so that no sum reads the partials
    of all tasks."""
    if n_parts * part_bytes <= DRIVER_BYTES:
        held = parts.select(*keys, "row").toArrow().combine_chunks()
    else:
        total = Summarizer.sum(F.col("row")).alias("row")
        held = (parts.withColumn("row", array_to_vector("row"))
                .groupBy(*keys, F.pmod(F.spark_partition_id(), F.lit(fan_in)).alias("part")).agg(total)
                .groupBy(*keys).agg(total).select(*keys, vector_to_array("row").alias("row"))).toArrow().combine_chunks()
    if not held.num_rows:
        return []
    rows, out = batch_matrix(held.column("row").combine_chunks()), {}
    for key, row in zip(zip(*(held.column(k).to_pylist() for k in keys)), rows):
        out[key] = out[key] + row if key in out else row
    return [(*key, row) for key, row in out.items()]


def count_parts(df: DataFrame) -> int:
    """Number of partitions that have rows."""
    return max(1, df.select(F.spark_partition_id().alias("p")).distinct().count())


@dataclass
class Moments:
    """Number of rows, means, population covariances, and second moments about the shift."""
    n: int
    mean: np.ndarray
    cov: np.ndarray
    second: np.ndarray

    def varying(self) -> np.ndarray:
        return np.diag(self.cov) > NOISE * np.maximum(self.second, 0)

    def scale(self) -> np.ndarray:
        """1 / population standard deviation; 1 for a column without variance."""
        ok = self.varying()
        return np.where(ok, 1.0 / np.sqrt(np.where(ok, np.diag(self.cov), 1.0)), 1.0)


@dataclass
class FoldSums:
    shift: np.ndarray
    sums: dict[int, np.ndarray]  # fold → products of its shifted rows with a 1 at their end

    @property
    def dim(self) -> int:
        return len(self.shift)

    def rows(self, fold: int) -> int:
        return round(float(self.sums[fold][-1, -1])) if fold in self.sums else 0

    def _moments(self, q: np.ndarray) -> Moments:
        n = q[-1, -1]
        if n < 0.5:
            raise ValueError("a training fold without rows")
        mean = q[-1, :-1] / n
        cov = q[:-1, :-1] / n - np.outer(mean, mean)
        return Moments(round(float(n)), self.shift + mean, (cov + cov.T) / 2, np.diag(q)[:-1] / n)

    def total(self) -> Moments:
        return self._moments(sum(self.sums.values()))

    def training(self, fold: int) -> Moments:
        """Of all rows outside a fold: the total less the fold's own sums."""
        total = sum(self.sums.values())
        return self._moments(total - self.sums[fold] if fold in self.sums else total)


def _products(shift: np.ndarray):
    d = len(shift)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ones((batch.num_rows, d + 1))
            x[:, :d] = batch_matrix(batch.column("x")) - shift
            folds = batch.column("fold").to_numpy()
            for f in np.unique(folds):
                own = x[folds == f]
                held[int(f)] = held.get(int(f), 0) + own.T @ own
        for f, q in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d + 1, f, np.int32)), pa.array(np.arange(d + 1, dtype=np.int32)), pa.array([*q], pa.list_(pa.float64()))],
                names=["fold", "i", "row"])
    return run


def fold_sums(data: DataFrame, x: Column, fold: Column | None = None) -> FoldSums:
    """One scan: sums of the rows ``x`` (``array<double>`` of equal lengths, no nulls) by fold (an int, not null)."""
    rows = data.select((fold if fold is not None else F.lit(0)).cast("int").alias("fold"), x.alias("x"))
    first = rows.select("x").limit(SHIFT_ROWS).toArrow().combine_chunks()
    if not first.num_rows:
        raise ValueError("no rows to take moments of")
    shift = batch_matrix(first.column("x").combine_chunks()).mean(axis=0)
    d = len(shift)
    parts = rows.mapInArrow(_products(shift), "fold int, i int, row array<double>")
    sums: dict[int, np.ndarray] = {}
    # Partials of the products go through the executors' sums from a few partitions on.
    for f, i, row in summed_rows(parts, ["fold", "i"], count_parts(rows), 8 * (d + 1) ** 2):
        sums.setdefault(f, np.zeros((d + 1, d + 1)))[i] = row
    return FoldSums(shift, sums)


@dataclass
class Space:
    """The scaled union of a training fold: x = matrix · raw + shift, with its covariances."""
    n: int
    matrix: np.ndarray
    shift: np.ndarray
    gram: np.ndarray


def scaled_union(m: Moments, n_num: int, k: int) -> Space:
    """M4 from moments: numerical block ∥ the first ``k`` components of the scaled
    embedding block, each column less its mean and over its population standard
    deviation. Components come by falling variance, their largest entry positive."""
    scale = m.scale()
    d = len(scale)
    matrix = np.zeros((n_num + k, d))
    matrix[:n_num, :n_num] = np.diag(scale[:n_num])
    if k:
        e = slice(n_num, d)
        corr = m.cov[e, e] * np.outer(scale[e], scale[e])
        values, vectors = np.linalg.eigh(corr)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
        ok = values > NOISE * max(float(values[0]), 0.0)
        matrix[n_num:, e] = (vectors * scale[e][:, None]).T / np.sqrt(np.where(ok, values, 1.0))[:, None]
    return Space(m.n, matrix, -matrix @ m.mean, matrix @ m.cov @ matrix.T)


def moment_table(sums: FoldSums, folds: Sequence[int], spark) -> DataFrame:
    """(fold, n, i, j, mean, value): training rows, the mean of column i and the covariance of i and j of each training fold."""
    rows = []
    for f in folds:
        m = sums.training(f)
        i, j = (v.ravel() for v in np.meshgrid(np.arange(sums.dim), np.arange(sums.dim), indexing="ij"))
        rows.append(pa.table({"fold": np.full(len(i), f, np.int32), "n": np.full(len(i), m.n, np.int64), "i": i.astype(np.int32),
                              "j": j.astype(np.int32), "mean": m.mean[i], "value": m.cov.ravel()}))
    return spark.createDataFrame(pa.concat_tables(rows))
