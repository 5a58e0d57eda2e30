"""Two-branch model.

Data flow per fold, as in the reference pipeline: numerical block ∥
(embedding block → population scaler → truncated SVD) → union → population
scaler → one L1 logistic regression per task. All stages before the regressions
follow from the moments of the training rows (``operators.moments``) and are one
affine map; an SVD with the largest k any trial asks for serves all trials: a trial
slices the first ``n_num + k`` columns of the scaled union — column-wise scaling
commutes with slicing. A fold's model persists as a ``PipelineModel``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosa.columns import LABELS, TASKS
from glosa.functions.registry import FeatureLayout
from glosa.operators.affine import AffineModel, LinearTaskModel
from glosa.operators.linalg import prefix_slicer
from glosa.operators.moments import Space, fold_sums, scaled_union

EMBEDDING_FEATURE = "EmbeddingFeature"


def c_to_reg_param(c: float, n_train: int) -> float:
    """liblinear minimises C·Σloss + ‖w‖₁; Spark minimises mean loss + λ‖w‖₁ → λ = 1/(C·N)."""
    return 1.0 / (c * n_train)


@dataclass
class SharedStages:
    """Per-fold stages shared by every trial (M1, M2, P5)."""
    model: PipelineModel
    prefix: str
    n_num: int
    k_max: int

    @property
    def output(self) -> str:
        return f"{self.prefix}x"


def raw_block(layout: FeatureLayout, num_col: str = "num", emb_col: str = "emb") -> tuple[list[str], Column, int, int]:
    """The input columns of a layout, their values as one array, and the widths of the two blocks."""
    n_num, emb_dim = len(layout.numerical), sum(d for _, d in layout.embeddings)
    if not n_num and not emb_dim:
        raise ValueError("the feature set has neither numerical nor embedding features")
    cols = ([num_col] if n_num else []) + ([emb_col] if emb_dim else [])
    return cols, F.concat(*[vector_to_array(c) for c in cols]), n_num, emb_dim


def shared_stages(space: Space, input_cols: list[str], prefix: str, n_num: int) -> SharedStages:
    """The stages as a pipeline of one affine map."""
    stage = AffineModel.of(input_cols, f"{prefix}x", space.matrix, space.shift)
    return SharedStages(PipelineModel(stages=[stage]), prefix, n_num, len(space.shift) - n_num)


def fit_shared(train: DataFrame, layout: FeatureLayout, k_max: int, prefix: str = "m_",
               num_col: str = "num", emb_col: str = "emb") -> SharedStages:
    """M4 minus the classifiers: numerical ∥ (scale → SVD(k_max)) → union → scale, from one scan of ``train``."""
    cols, raw, n_num, emb_dim = raw_block(layout, num_col, emb_col)
    k = max(1, min(k_max, emb_dim)) if emb_dim else 0
    return shared_stages(scaled_union(fold_sums(train, raw).total(), n_num, k), cols, prefix, n_num)


def raw_affine(shared: SharedStages, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and shift that take a raw row (numerical block, then embedding block)
    to the first ``width`` scaled columns: scaler, projection and scaler in one."""
    matrix, shift = shared.model.stages[0].numbers()
    return matrix[:width], shift[:width]


def positive_margins(weights: np.ndarray, intercepts: np.ndarray):
    """Batched column function: an array<double> row → 0/1 for each row of ``weights``."""
    @F.pandas_udf("array<int>")
    def margins(rows: pd.Series) -> pd.Series:
        x = np.vstack(rows.to_numpy()) if len(rows) else np.zeros((0, weights.shape[1]))
        return pd.Series(list((x @ weights.T + intercepts > 0).astype(np.int32)))
    return margins


def trial_features(shared: SharedStages, k: int) -> PipelineModel:
    """The first ``n_num + k`` scaled columns."""
    k = min(k, shared.k_max)
    return PipelineModel(stages=[prefix_slicer(shared.output, f"{shared.prefix}xk", shared.n_num + k)])


def check_both_classes(train: DataFrame, labels: Sequence[str] = LABELS) -> None:
    """Q15: a task with one class in the training fold cannot be fitted."""
    r = train.agg(*[F.countDistinct(F.col(c)).alias(c) for c in labels]).first()
    single = [c for c in labels if (r[c] or 0) < 2]
    if single:
        raise ValueError(f"single class in the training fold for {single}; use fewer folds or more data")


def fit_task(train_x: DataFrame, features_col: str, label: str, c: float, n_train: int,
             prefix: str, task_idx: int, max_iter: int = 300, tol: float = 1e-3) -> LogisticRegressionModel:
    """M3, a single L1 logistic regression by Spark ML (intercept unpenalised, Q11); a search
    fits its trials together (``operators.paths``). ``tol`` is on the relative loss change."""
    lr = LogisticRegression(featuresCol=features_col, labelCol=label, family="binomial",
                            elasticNetParam=1.0, regParam=c_to_reg_param(c, n_train), standardization=False,
                            maxIter=max_iter, tol=tol,
                            predictionCol=f"{prefix}pred_{task_idx}", rawPredictionCol=f"{prefix}raw_{task_idx}",
                            probabilityCol=f"{prefix}prob_{task_idx}")
    return lr.fit(train_x)


@dataclass
class FoldModel:
    """M8: shared stages + slice + one regression per task; ``predict`` adds
    ``pred_cols`` (0/1 ints) and drops every intermediate column."""
    shared: SharedStages
    k: int
    c: float
    regressions: list[LogisticRegressionModel | LinearTaskModel]
    pred_cols: list[str]

    def pipeline(self) -> PipelineModel:
        return PipelineModel(stages=list(self.shared.model.stages) + list(trial_features(self.shared, self.k).stages)
                             + list(self.regressions))

    def predict(self, df: DataFrame) -> DataFrame:
        if not self.regressions:
            raise ValueError("this fold has no regressions yet: tune or fit it before predicting")
        out = self.pipeline().transform(df)
        p = self.shared.prefix
        preds = [F.col(f"{p}pred_{i}").cast("int").alias(c) for i, c in enumerate(self.pred_cols)]
        return out.select(*df.columns, *preds)

    def affine(self) -> list[tuple[np.ndarray, float]]:
        """Weights and intercept of each task on the raw blocks (numerical, then
        embedding): all stages before the regressions are affine."""
        if not self.regressions:
            raise ValueError("this fold has no regressions yet: tune or fit it before predicting")
        matrix, shift = raw_affine(self.shared, self.shared.n_num + min(self.k, self.shared.k_max))
        return [(matrix.T @ c, float(m.intercept) + float(shift @ c))
                for m, c in zip(self.regressions, self.coefficients())]

    def coefficients(self) -> list[np.ndarray]:
        return [m.coefficients.toArray() for m in self.regressions]


def feature_importance(spark: SparkSession, models: dict[int, FoldModel], layout: FeatureLayout,
                       top_k: int = 10, tasks: Sequence[str] = TASKS) -> DataFrame:
    """M9: |coefficient| per (fold, task); numerical names first, reduced
    components are ``EmbeddingFeature``; the ``top_k`` largest per group
    (ties by position). Coefficients are model metadata (≤ width per task)."""
    rows = []
    for fold, m in models.items():
        names = list(layout.numerical_names) + [EMBEDDING_FEATURE] * min(m.k, m.shared.k_max)
        for task, coef in zip(tasks, m.coefficients()):
            for idx, (name, v) in enumerate(zip(names, np.abs(coef))):
                rows.append((int(fold), task, idx, name, float(v)))
    df = spark.createDataFrame(rows, "fold int, task string, idx int, name string, importance double")
    return top_k_importance(df, top_k)


def top_k_importance(coefs: DataFrame, top_k: int) -> DataFrame:
    """Top-k per (fold, task); the limit is the feature here."""
    w = Window.partitionBy("fold", "task").orderBy(F.desc("importance"), F.asc("idx"))
    return coefs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
