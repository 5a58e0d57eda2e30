"""Sinks: submission files (S6), metric log table (S7), model store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, LABELS, TEXT
from glosa.session import path_exists, shuffles_dropped


def submission_frame(rows: DataFrame, with_text: bool = True) -> DataFrame:
    """Test rows with their three predictions, aligned by column, not position."""
    cols = [COMMENT_ID] + ([TEXT] if with_text else []) + list(LABELS)
    return rows.select(*cols)


def attach_predictions(test: DataFrame, predictions: DataFrame) -> DataFrame:
    """Join predictions computed elsewhere back to the test rows by id."""
    return test.select(COMMENT_ID, TEXT).join(predictions.select(COMMENT_ID, *LABELS), COMMENT_ID, "left")


def write_submission(rows: DataFrame, out_dir: str) -> None:
    """``submission_with_text`` and ``submission`` (text dropped) as header CSV."""
    w = dict(header=True, escape='"', quoteAll=False)
    with shuffles_dropped(rows.sparkSession):
        submission_frame(rows, True).write.mode("overwrite").options(**w).csv(f"{out_dir}/submission_with_text")
        submission_frame(rows, False).write.mode("overwrite").options(**w).csv(f"{out_dir}/submission")


def append_metrics(metrics: DataFrame, path: str, run: str) -> None:
    """Append per-fold, per-task metrics to a Parquet log table."""
    (metrics.withColumn("run", F.lit(run)).withColumn("logged_at", F.current_timestamp())
     .write.mode("append").parquet(path))


def save_model(model, path: str) -> None:
    """ML persistence instead of pickles."""
    model.write().overwrite().save(path)


def load_or_fit(spark, path: str, key: str, fit, loader):
    """Load the model stored under ``path`` if its manifest has this ``key``,
    otherwise fit and store it. Errors while reading a stored model are raised."""
    manifest = f"{path}/manifest"
    if path_exists(spark, manifest) and spark.read.parquet(manifest).where(F.col("key") == key).count():
        return loader.load(f"{path}/model")
    model = fit()
    save_model(model, f"{path}/model")
    spark.createDataFrame([(key,)], "key string").coalesce(1).write.mode("overwrite").parquet(manifest)
    return model
