"""Lookup tables: loaders and the test tables derived from the corpus.

Real deployments pass their own tables (word vectors, polarity lexicon,
vocabularies, document vectors). The derived tables below are built by Spark
from the comment texts so that every lookup operator can be checked against
an independent SQL query; their formulas are test definitions, not models.
Each derived table is written once to the shared checkpoint folder: the
broadcast size check and the join then read that copy instead of deriving the
table from the whole corpus twice, and a lost executor does not recompute it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, TEXT
from glosa.operators.words import word_frequencies
from glosa.session import cut_lineage

UNK = "<UNK>"
WORDS = {"token", "_n"}


def distinct_tokens(comments: DataFrame, text_col: str = TEXT, lower: bool = True) -> DataFrame:
    """(token): from the texts, or from ``stored_words`` of them."""
    if WORDS <= set(comments.columns):
        return comments.select("token")
    return word_frequencies(comments, F.lower(F.col(text_col)) if lower else F.col(text_col)).select("token")


def stored_words(comments: DataFrame, text_col: str = TEXT) -> DataFrame:
    """(token, _n): lower-cased tokens and their occurrences, stored; all derived tables take it in place of the comments."""
    return cut_lineage(word_frequencies(comments, F.lower(F.col(text_col))))


def derived_word_vectors(comments: DataFrame, text_col: str = TEXT) -> DataFrame:
    """``(token, vector)`` for lower-cased tokens of 3+ characters:
    ``[length, length % 3, position of 'e']``."""
    return cut_lineage(
        distinct_tokens(comments, text_col).where(F.length("token") >= 3)
        .select("token", F.array(F.length("token").cast("double"), (F.length("token") % 3).cast("double"),
                                 F.instr("token", "e").cast("double")).alias("vector")))


def derived_wide_vectors(comments: DataFrame, dim: int = 300, text_col: str = TEXT) -> DataFrame:
    """``(token, vector)`` for lower-cased tokens of 3+ characters: at place d (from 0)
    ``(length * (d + 1) + position of 'e') % 13 - 6``."""
    @F.arrow_udf("array<double>")
    def value(sizes: pa.Array, at: pa.Array) -> pa.Array:
        numbers = (np.outer(sizes.to_numpy(zero_copy_only=False), np.arange(1, dim + 1)) + at.to_numpy(zero_copy_only=False)[:, None]) % 13 - 6
        return pa.FixedSizeListArray.from_arrays(pa.array(numbers.astype(float).ravel()), dim).cast(pa.list_(pa.float64()))
    words = distinct_tokens(comments, text_col).where(F.length("token") >= 3)
    return cut_lineage(words.select("token", value(F.length("token"), F.instr("token", "e")).alias("vector")))


def derived_polarity(comments: DataFrame, text_col: str = TEXT) -> DataFrame:
    """``(token, polarity)`` for lower-cased tokens of 4+ characters:
    ``(length % 5 - 2) / 2`` in [-1, 1]."""
    return cut_lineage(
        distinct_tokens(comments, text_col).where(F.length("token") >= 4)
        .select("token", ((F.length("token") % 5 - 2) / 2.0).alias("polarity")))


def derived_word_vocab(comments: DataFrame, size: int | None = None, text_col: str = TEXT) -> DataFrame:
    """Lower-cased tokens by frequency (ties by token), ids from 2; ``<UNK>`` = 1 and
    0 is padding. All tokens, or the ``size`` most frequent.

    Ranks come from a range-partitioned sort: rows are numbered within their
    partition and shifted by the rows of the partitions before it (one row each)."""
    counted = comments if WORDS <= set(comments.columns) else word_frequencies(comments, F.lower(F.col(text_col)))
    freq = counted.select("token", F.col("_n").alias("n"))
    order = [F.desc("n"), F.asc("token")]
    top = freq.orderBy(*order).limit(size) if size is not None else freq.repartitionByRange(*order)
    placed = cut_lineage(top.withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
             .select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift")))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = (placed.withColumn("inside", inside).join(F.broadcast(shift), "part")
              .select("token", (F.col("shift") + F.col("inside") + 1).cast("int").alias("id")))
    return cut_lineage(
        ranked.unionByName(comments.sparkSession.createDataFrame([(UNK, 1)], "token string, id int")))


def derived_char_vocab(spark) -> DataFrame:
    """``a``–``z`` with ids from 2 and ``<UNK>`` = 1."""
    rows = [(chr(ord("a") + i), i + 2) for i in range(26)] + [(UNK, 1)]
    return spark.createDataFrame(rows, "token string, id int")


def doc_vectors_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """``embeddings(vec_id, embedding)`` as ``(comment_id, vector array<double>)``."""
    return embeddings.select(F.col("vec_id").alias(COMMENT_ID),
                             F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
