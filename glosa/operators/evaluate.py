"""Evaluation tables (A1, A2, M6) over long prediction tables.

A long prediction table has one row per (item, fold, task) with a 0/1
``label`` and ``pred``. Every metric is one grouped aggregation of
conditional sums — partial aggregation collapses it map-side, so a fold or a
task holding most rows costs nothing extra — followed by row arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, FOLD, LABELS, TASKS

METRICS = ["accuracy", "precision", "recall", "f1"]


def to_long(df: DataFrame, pred_cols: Sequence[str], label_cols: Sequence[str] = LABELS,
            tasks: Sequence[str] = TASKS, keep: Sequence[str] = (COMMENT_ID, FOLD)) -> DataFrame:
    """Wide (one label and one prediction column per task) → long rows (narrow)."""
    items = [F.struct(F.lit(t).alias("task"), F.col(lc).cast("int").alias("label"),
                      F.col(pc).cast("int").alias("pred"))
             for t, lc, pc in zip(tasks, label_cols, pred_cols)]
    return (df.select(*keep, F.explode(F.array(*items)).alias("_r"))
            .select(*keep, "_r.task", "_r.label", "_r.pred"))


def _ratio(num: Column, den: Column) -> Column:
    """0 when undefined, as the scoring library does."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion(long: DataFrame, by: Sequence[str] = (FOLD, "task")) -> DataFrame:
    y, p = F.col("label"), F.col("pred")

    def cnt(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return long.groupBy(*by).agg(cnt((y == 1) & (p == 1)).alias("tp"), cnt((y == 0) & (p == 0)).alias("tn"),
                                 cnt((y == 0) & (p == 1)).alias("fp"), cnt((y == 1) & (p == 0)).alias("fn"))


def task_metrics(long: DataFrame, by: Sequence[str] = (FOLD, "task")) -> DataFrame:
    """A1: accuracy and class-macro precision / recall / F1 per group.

    Classes are those present in labels or predictions; an undefined ratio is
    0; F1 per class is 2·tp / (2·tp + fp + fn)."""
    c = confusion(long, by)
    tp, tn, fp, fn = F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")
    has1 = (tp + fn + fp > 0).cast("int")
    has0 = (tn + fp + fn > 0).cast("int")
    n_cls = has0 + has1

    def macro(v0: Column, v1: Column) -> Column:
        return _ratio(has0 * v0 + has1 * v1, n_cls)
    return c.select(
        *by,
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        macro(_ratio(tn, tn + fn), _ratio(tp, tp + fp)).alias("precision"),
        macro(_ratio(tn, tn + fp), _ratio(tp, tp + fn)).alias("recall"),
        macro(_ratio(2 * tn, 2 * tn + fp + fn), _ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def metrics_summary(metrics: DataFrame, by: str = "task") -> DataFrame:
    """A2: mean and population std over folds."""
    aggs = []
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return metrics.groupBy(by).agg(*aggs)


def multilabel_macro_f1(long: DataFrame, by: Sequence[str] = (FOLD,)) -> DataFrame:
    """M6: F1 of the positive class per task, averaged over tasks (the search
    objective)."""
    c = confusion(long, (*by, "task"))
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.groupBy(*by).agg(F.avg(f1).alias("macro_f1"))
