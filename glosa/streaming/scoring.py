"""Incremental scoring of arriving comments with a fitted fold ensemble.

The batch run (``plans.pipeline.run``) predicts one test file. Here the same
prediction — every feature, every fold model, the in-row vote — runs on each
micro-batch of a file stream:

* the source is ``readStream`` over a folder of Parquet (or header CSV)
  comment files with a fixed schema; ``maxFilesPerTrigger`` bounds a batch;
* ``foreachBatch`` runs the batch feature plan on the micro-batch (table-backed
  features need a grouped aggregate per comment, which a plain streaming plan
  could only run with a watermark) and the fitted ``FoldModel``s;
* each batch writes into its own ``batch_id=<n>`` partition with dynamic
  partition overwrite, so a batch replayed after a failure replaces its own
  output instead of duplicating rows;
* progress lives in a checkpoint under the shared folder
  (``spark.checkpoint.dir``), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from glosa.columns import COMMENT_ID, LABELS, TEXT
from glosa.functions.registry import FeatureAssets, FeatureLayout, build_features
from glosa.operators.model import FoldModel
from glosa.session import shared_dir
from glosa.sources.comments import TEST_SCHEMA

BATCH_ID = "batch_id"


def comment_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = TEST_SCHEMA,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming comment table ``(comment_id, c_text)`` over a folder of files."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path).select(F.col(COMMENT_ID), F.col(TEXT))


def score_batch(batch: DataFrame, features: Sequence[str], assets: FeatureAssets, layout: FeatureLayout,
                models: dict[int, FoldModel]) -> DataFrame:
    """The batch prediction plan on one micro-batch: ``comment_id`` + three 0/1 labels."""
    from glosa.plans.pipeline import predict_ensemble
    feats, _ = build_features(batch, list(features), assets)
    return predict_ensemble(feats, layout, models)


def start_scoring(stream: DataFrame, features: Sequence[str], assets: FeatureAssets, layout: FeatureLayout,
                  models: dict[int, FoldModel], out_path: str, checkpoint: str | None = None,
                  available_now: bool = False, processing_time: str | None = None) -> StreamingQuery:
    """Start the scoring query; returns the running ``StreamingQuery``.

    ``available_now`` processes what is in the folder and stops (a scheduled
    incremental job); otherwise a micro-batch runs every ``processing_time``.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or f"{shared_dir(spark)}/stream-score-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        preds = score_batch(batch, features, assets, layout, models).withColumn(BATCH_ID, F.lit(int(batch_id)))
        (preds.select(COMMENT_ID, *LABELS, BATCH_ID).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BATCH_ID).parquet(out_path))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
