"""Fold-ensemble vote (M10): positive when votes ≥ n/2, so a tie is positive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID


def vote(preds: Sequence[Column]) -> Column:
    """In-row vote over one prediction column per model — no shuffle, used when
    all fold models score the same rows."""
    if not preds:
        raise ValueError("no models to vote")
    total = preds[0].cast("int")
    for p in preds[1:]:
        total = total + p.cast("int")
    return (2 * total >= F.lit(len(preds))).cast("int")


def vote_long(preds: DataFrame, key: Sequence[str] = (COMMENT_ID, "task"), pred_col: str = "pred") -> DataFrame:
    """Vote over a long table ``(key…, model, pred)``. Each group holds one row
    per model, so groups are bounded by the ensemble size."""
    return preds.groupBy(*key).agg(
        (2 * F.sum(F.col(pred_col).cast("int")) >= F.count(F.lit(1))).cast("int").alias("vote"))
