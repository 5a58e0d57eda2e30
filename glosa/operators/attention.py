"""Attention-style pooling (G9): softmax of scores inside a group, then the
score-weighted sum of the item vectors.

``w = exp(s - max_group(s)) / Σ_group exp(s - max)``; masked items are simply
absent rows. No group is ever materialised in one task and items are read and shuffled
as map-side combined sums only: no maximum is joined back. Weights are taken relative to
the end of a fixed stretch of scores, which any task knows, so they neither overflow nor
vanish; sums of several stretches are set to the highest one at the end.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.operators.lookups import BLOCK_DIMS


STRETCH = 64.0  # scores of a part lie within so much of each other


def softmax_pool(items: DataFrame, group: str, score: str, vector: str, out: str = "pooled",
                 strategy: str = "auto", salt_cols: list[str] | None = None, dim: int | None = None) -> DataFrame:
    """``items(group, score double, vector array<double>)`` → ``(group, pooled)``.

    Items are read once: sums of each part of a group, by stretches of the score, come with
    the weight exp(score - end of the stretch); parts are then set to the group's highest one.
    With ``dim``, the vectors' width, sums are plain ones in blocks. ``strategy`` and
    ``salt_cols`` have no part in it: nothing is joined."""
    part = F.floor(F.col(score) / F.lit(STRETCH)).cast("double")
    weight = F.exp(F.col(score) - (part + 1) * STRETCH)
    rows = items.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), part.alias("_part"), weight.alias("_w"),
                                                        F.col(vector).cast("array<double>").alias("_v"))
    if dim is None:
        rows = rows.withColumn("_v", array_to_vector("_v"))
        sums = rows.groupBy("_g", "_part").agg(F.sum("_w").alias("_z"), Summarizer.sum(F.col("_v"), F.col("_w")).alias("_s"))
        sums = sums.select("_g", "_part", F.lit(0).alias("_b"), "_z", vector_to_array("_s").alias("_s"))
    else:
        blocks = F.array(*[F.slice("_v", a + 1, BLOCK_DIMS) for a in range(0, dim, BLOCK_DIMS)])
        rows = rows.select("_g", "_part", "_w", F.posexplode(blocks).alias("_b", "_v"))
        wide = [F.sum(F.get("_v", F.lit(j)) * F.col("_w")) for j in range(min(dim, BLOCK_DIMS))]
        sums = rows.groupBy("_g", "_part", "_b").agg(F.sum("_w").alias("_z"), F.array(*wide).alias("_s"))
    # A group has few parts: its scores' range over the stretch.
    parts = sums.groupBy("_g").agg(F.max("_part").alias("_top"), F.sort_array(F.collect_list(F.struct("_b", "_part", "_z", "_s"))).alias("_p"))
    less = F.transform("_p", lambda p: F.struct(p["_b"].alias("b"), F.exp((p["_part"] - F.col("_top")) * STRETCH).alias("w"),
                                                p["_z"].alias("z"), p["_s"].alias("s")))
    parts = parts.select("_g", less.alias("_p"))
    z = F.aggregate(F.filter("_p", lambda p: p["b"] == 0), F.lit(0.0), lambda n, p: n + F.coalesce(p["z"] * p["w"], F.lit(0.0)))
    n_blocks = 1 if dim is None else -(-dim // BLOCK_DIMS)

    def block(b: int) -> Column:
        own = F.transform(F.filter("_p", lambda p: p["b"] == b), lambda p: F.transform(p["s"], lambda x: F.coalesce(x * p["w"], F.lit(0.0))))
        return F.aggregate(own, F.array().cast("array<double>"),
                           lambda n, s: F.when(F.size(n) == 0, s).otherwise(F.zip_with(n, s, lambda x, y: x + y)))
    total = F.concat(*[block(b) for b in range(n_blocks)])
    sums = parts.select("_g", z.alias("_z"), (F.slice(total, 1, dim) if dim else total).alias("_s"))
    return sums.select(F.col("_g").alias(group), F.transform("_s", lambda x: F.try_divide(x, F.col("_z"))).alias(out))


def attention_two_level(items: DataFrame, doc: str, window: str, score: str, vector: str, context: list[float],
                        out: str = "pooled", strategy: str = "auto") -> DataFrame:
    """Words → window vector → document vector: ``(doc, pooled)``.

    ``items(doc, window, score, vector)`` has a row for each word that is not masked; a
    window or document without rows is absent. Words are pooled by their scores within
    their window, windows by the product of their vectors with ``context`` within their
    document. A document is dealt out by its windows on the first level; on the second a
    row is a window, and sums of a long document combine where its windows lie."""
    keyed = items.select(F.struct(F.col(doc).alias("doc"), F.col(window).alias("window")).alias("_key"), F.col(score).alias("_score"),
                         F.col(vector).alias("_vector"))
    windows = softmax_pool(keyed, "_key", "_score", "_vector", out="_w", dim=len(context))
    weight = F.aggregate(F.zip_with("_w", F.array(*[F.lit(float(c)) for c in context]), lambda a, c: a * c), F.lit(0.0), lambda a, x: a + x)
    scored = windows.select(F.col("_key.doc").alias(doc), F.col("_key.window").alias(window), weight.alias("_score"), "_w")
    return softmax_pool(scored, doc, "_score", "_w", out=out, dim=len(context))
