"""Corpus pipeline: quality, near duplicates, benchmark passages, mix, token files.

Each stage takes all documents that the one before it kept, is written as
Parquet in the shared folder and read again as the next one's input. All but
the last return the columns of their input. ``run`` ends with a row per
document of the mix: doc_id, start, n_tokens and ids_crc32, read back from the
token files; a document that the mix takes n times has n rows.

Nulls, repeated rows, ties and empty tables are defined by the operators. Of a
group of near duplicates one row stays: of those with the least id the one with
the least hash of its text, and of equal rows one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosa.llm.common import stored, table
from glosa.llm.decontaminate import contaminated
from glosa.llm.minhash import one_of_each
from glosa.llm.mixing import mixed_documents
from glosa.llm.quality import quality_cascade
from glosa.llm.queries import tokenizer_path
from glosa.llm.tokens import token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the cascade of rules."""
    return quality_cascade(docs).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8 or more."""
    return one_of_each(docs, shingle=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of the benchmark."""
    return contaminated(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids in the token files."""
    return token_files(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources),
          ("tokens", token_output)]

# A tokenizer is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
