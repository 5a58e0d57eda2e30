"""Registered queries of the training-data operators and their DuckDB oracles.

Each query applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosa.llm.chat import format_chats
from glosa.llm.common import WORD, table
from glosa.llm.decontaminate import contaminated
from glosa.llm.hard_negatives import hard_negatives
from glosa.llm.language import fit_text_model, identify, page_items
from glosa.llm.line_dedup import site_lines
from glosa.llm.minhash import near_duplicates
from glosa.llm.mixing import mix
from glosa.llm.oracles import ORACLES  # noqa: F401 (read by the entry)
from glosa.llm.quality import BASE, quality_cascade
from glosa.llm.runs import periodic_runs
from glosa.llm.secrets import secrets
from glosa.llm.tokens import token_files
from glosa.llm.url_filter import UrlRule, host_and_path, url_verdicts
from glosa.llm.warc import archived

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_snapshot_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal logged conversations, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


@query
def op2_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page without its site's boilerplate lines."""
    return site_lines(table(spark, sf_dir, "pages"))


LANGUAGE_SAMPLE_ROWS = 4000


@query
def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and page.

    The text model is fitted on LANGUAGE_SAMPLE_ROWS labelled documents. A
    document's host is its source; its label is not evidence. Pages bring
    markup, suffix and host. Ids of the other table are null.
    """
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = fit_text_model(docs, "text", "lang", LANGUAGE_SAMPLE_ROWS)
    none = F.lit(None).cast("string")
    items = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("markup"),
                        none.alias("suffix"), F.concat(F.lit("source:"), "source").alias("host"), none.alias("parent"))
    items = items.unionByName(page_items(pages).select(
        F.lit(None).cast("long").alias("doc_id"), "page.page_id", "text", "markup", "suffix", "host", "parent"))
    return identify(items, model).select("row.doc_id", "row.page_id", "language", F.round("probability", 6).alias("probability"),
                                         "text_language")


@query
def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.85 or more."""
    groups = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)
    return groups.select("doc_id", "n_shingles", "component_id", "kept", "class_size")


@query
def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix takes."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the cascade's verdict."""
    scored = quality_cascade(table(spark, sf_dir, "documents"))
    return scored.select("row.doc_id", *BASE, "base_failed", "kept")


@query
def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(TOKENIZER))


@query
def op7_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's token ids, read back from the shards."""
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op6_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets(table(spark, sf_dir, "documents"))


@query
def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record after a round trip through archives."""
    return archived(table(spark, sf_dir, "pages"))


# Fixed values of the contract.
URL_RULES = [UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"),
             UrlRule("allow", "org", "/fr/")]
LISTED_HOSTS = r"(^|[.-])(casino|bets|pills|spam)([.-]|$)"


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url. The list has the urls of all pages on hosts with a listed word in their name."""
    pages = table(spark, sf_dir, "pages")
    host, _ = host_and_path(F.col("url"))
    judged = url_verdicts(pages, pages.where(host.rlike(LISTED_HOSTS)), URL_RULES, carry=["page_id"])
    return judged.select("row.page_id", "host", "path", "rule", "canonical", "verdict")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has the next label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; of a tenth of the documents, chosen by their id's crc32, the words repeat from some place on."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.coalesce(F.size("words"), F.lit(0))).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)"))
    rows = rows.withColumn("p", F.expr("1 + cast(floor((n - a) / (3 + g % 8)) as int)"))
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), 12)), 1, n - a)"  # p is over a twelfth of n - a
    return rows.select("doc_id", F.expr(f"if(n > 0, array_join(concat(slice(words, 1, a), {tail}), ' '), text)").alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document, and its text without their repetitions."""
    found = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents")), carry=["doc_id"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    return found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
