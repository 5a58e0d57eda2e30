"""Comment sources: CSV files (S1/S3) and the views built from the test tables.

CSV with quoted newlines has to be read with ``multiLine``, which makes each
file a single split; ingest once to Parquet (``ingest_csv``) and run every
later job from the Parquet copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosa.columns import COMMENT_ID, FOLD, LABELS, TEXT

TRAIN_SCHEMA = T.StructType(
    [T.StructField(COMMENT_ID, T.StringType()), T.StructField(TEXT, T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in LABELS]
)
TEST_SCHEMA = T.StructType([T.StructField(COMMENT_ID, T.StringType()), T.StructField(TEXT, T.StringType())])
FOLDED_SCHEMA = T.StructType(list(TRAIN_SCHEMA.fields) + [T.StructField(FOLD, T.IntegerType())])


def read_comments_csv(spark: SparkSession, path: str, labelled: bool = True, sep: str = ",",
                      schema: T.StructType | None = None) -> DataFrame:
    """Header CSV, fields by name, quotes and newlines round-trip."""
    schema = schema or (TRAIN_SCHEMA if labelled else TEST_SCHEMA)
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True)
            .option("escape", '"').option("sep", sep)
            .csv(path))


def write_comments_csv(df: DataFrame, path: str | None = None, sep: str = ",") -> str:
    """Header CSV with quoted fields (S3/S6 layout); defaults to a fresh folder
    under the shared checkpoint directory. Returns the path written."""
    if path is None:
        import uuid
        from glosa.session import shared_dir
        path = f"{shared_dir(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("sep", sep)
     .csv(path))
    return path


def read_folded_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pre-folded corpus: ``;``-separated with a ``fold`` column."""
    return read_comments_csv(spark, path, sep=";", schema=FOLDED_SCHEMA)


def ingest_csv(df: DataFrame, out_path: str, partitions: int | None = None) -> None:
    """Write a CSV-read frame once to Parquet so later scans split and prune."""
    if partitions:
        df = df.repartition(partitions)
    df.write.mode("overwrite").parquet(out_path)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Parallelism floor for CPU-heavy text work.

    A large input already arrives in many splits and is returned unchanged; a
    scan of a few big row groups (fewer splits than cores) is spread round-robin
    so the regex and array work runs on every core.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def has_labels(df: DataFrame) -> bool:
    """All three label columns present (by name)."""
    return set(LABELS) <= set(df.columns)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Decoration that makes every text feature vary on the generated documents;
# the oracle SQL uses the same expression.
COMMENTS_DECORATION = (
    "text"
    " || repeat(' @USER', CAST(doc_id % 3 AS INT))"
    " || repeat(' @medium', CAST(doc_id % 4 AS INT))"
    " || repeat(' https://ex.org/a', CAST(doc_id % 5 AS INT))"
    " || repeat(' \U0001F600', CAST(doc_id % 7 AS INT))"
    " || repeat(' \U0001F389', CAST(doc_id % 2 AS INT))"
)


def comments_view(documents: DataFrame) -> DataFrame:
    """``documents`` → comment table ``(comment_id, c_text)``."""
    return documents.select(F.col("doc_id").alias(COMMENT_ID), F.expr(COMMENTS_DECORATION).alias(TEXT))


def labelled_view(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Comments with three 0/1 labels: toxic, quality, and 'text has a digit'."""
    docs = documents.select(F.col("doc_id").alias(COMMENT_ID), F.expr(COMMENTS_DECORATION).alias(TEXT),
                            F.regexp_like("text", F.lit("[0-9]")).cast("int").alias(LABELS[2]))
    return (docs.join(labels.select(F.col("doc_id").alias(COMMENT_ID), "toxic", "quality"), COMMENT_ID)
            .select(COMMENT_ID, TEXT,
                    F.col("toxic").cast("int").alias(LABELS[0]),
                    F.col("quality").cast("int").alias(LABELS[1]),
                    F.col(LABELS[2])))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments_view(load_table(spark, sf_dir, "documents"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_view(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))
