"""Operator 3: language by Bayesian fusion of text, markup, address and host.

For each language l of the model,

    log P(l | all) = T log P(text | l) + log P(markup | l) + log P(suffix | l) + log P(l | host) + const

* text: a multinomial model of byte trigrams in 65,536 hash classes, for every
  language that has a labelled text of three bytes or more, fitted on a bounded
  sample. Copies of a (text, label) count once there. A language's quota is
  ``sample_rows`` divided by the languages, LEAST_ROWS at least, and what smaller
  languages leave of ``sample_rows`` is shared out among the larger ones: one with
  no more texts than its quota gives them all, another those of least hash. T < 1 (``temper``) allows for trigrams not being independent, so that
  short texts lean on the other evidence and long ones decide for themselves;
* markup and suffix: how often rows whose text speaks for l declare this
  language or have this address suffix, smoothed by ``alpha``; a row without
  one has no such term;
* host: the host's share of l, smoothed towards that of its parent domain,
  which is smoothed towards that of all rows (weight ``kappa`` each). A row's
  own vote is taken off its host's.

The counts behind all but the text are grouped aggregations over all rows.
Each leaves a row for a value, with a sum per language, so hosts and suffixes
that very many rows share are pre-aggregated; the join back is split where a
host is hot.

A null or empty text has no say and no vote. Null markup, suffix or host mean
no such evidence (a null host takes the prior of all rows). Repeated rows vote
each. Without any labelled text no language is known: every row comes out with a null
language, probability and text language. More than MAX_LANGUAGES labels are an error
(the sample and the model are bounded by that number).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosa.llm.common import slices, stored

CLASSES = 1 << 16
SLICE_BYTES = 4_000_000
LEAST_ROWS = 100
MAX_LANGUAGES = 500
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _classes(data: bytes) -> np.ndarray:
    """Hash class of the trigram at each byte but the last two."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return code >> np.uint32(16)


def _count(langs: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), CLASSES), np.int64)
        for part in batches:
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                if len(text) >= 3:
                    counts[langs.index(lang)] += np.bincount(_classes(text.translate(LOWER)), minlength=CLASSES)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(counts[at])],
                                         names=["lang", "class", "n"])
    return run


def quotas(sizes: dict[str, int], sample_rows: int) -> dict[str, int]:
    """Rows to take of each language: the least languages whole, the rest in equal parts."""
    out, left = {}, sample_rows
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(left // (len(sizes) - k), LEAST_ROWS))
        left = max(left - out[lang], 0)
    return out


def _sampled(rows: DataFrame, sample_rows: int) -> DataFrame:
    """Distinct (text, lang) rows of least hash, by the languages' quotas.

    Distinct rows are counted by their hashes. The texts that are drawn from lie
    in the share of the hash range where a quota's rows are expected, and some
    more; so the ranking within a language sees little more than its quota.
    """
    keyed = rows.select("text", "lang", F.xxhash64("text", "lang").alias("a"), F.xxhash64(F.lit(1), "text", "lang").alias("b"))
    sizes = keyed.select("lang", "a", "b").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in sizes.limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    if not sizes:
        return rows.limit(0)
    wanted = [(k, n, 1.0 if n == sizes[k] else (n + 10 * n ** 0.5 + 20) / sizes[k]) for k, n in quotas(sizes, sample_rows).items()]
    wanted = F.broadcast(rows.sparkSession.createDataFrame(wanted, "lang string, quota long, share double"))
    near = keyed.join(wanted, "lang").where(F.shiftrightunsigned("a", 11) < F.col("share") * float(1 << 53))
    near = near.groupBy("lang", "a", "b").agg(F.first("text").alias("text"), F.first("quota").alias("quota"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("a", "b"))
    return near.withColumn("place", place).where("place <= quota").select("text", "lang")


def fit_text_model(labelled: DataFrame, text_col: str, lang_col: str, sample_rows: int) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by language and class) of all labels, from a bounded sample of each."""
    rows = labelled.select(F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("text is not null and lang is not null and octet_length(text) >= 3")
    sample = stored(_sampled(rows, sample_rows), "sample")
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((0, CLASSES), np.float32)
    # As many rows as languages times classes, whatever the input's size.
    counts = np.zeros((len(langs), CLASSES))
    partial = sample.mapInArrow(_count(langs), "lang long, class long, n long")
    found = partial.groupBy("lang", "class").agg(F.sum("n").alias("n")).toArrow()
    counts[found["lang"].to_numpy(), found["class"].to_numpy()] = found["n"].to_numpy()
    return langs, np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)).astype(np.float32)


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for part in slices(batches, "text", SLICE_BYTES):
            texts = [(t or b"").translate(LOWER) for t in part.column("text").to_pylist()]
            data = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            starts = ends - [len(t) for t in texts]
            used = np.maximum(ends - starts - 2, 0)
            scores = np.zeros((len(texts), len(table)))
            if len(data) >= 3:
                classes = _classes(data)
                for k, row in enumerate(table):
                    sums = np.concatenate(([0.0], np.cumsum(row[classes], dtype=np.float64)))
                    last = len(classes)
                    scores[:, k] = sums[np.minimum(starts + used, last)] - sums[np.minimum(starts, last)]
            best = [int(i) if n else None for i, n in zip(scores.argmax(axis=1), used, strict=True)]
            scores[used == 0] = 0.0
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array([*scores], pa.list_(pa.float64())), pa.array(best, pa.int32())],
                names=["row", "score", "vote"])
    return run


def _votes(rows: DataFrame, key: str | None, n: int, into: str) -> DataFrame:
    """Votes by language for each value of a column (or over all), as an array."""
    sums = [F.sum(F.when(F.col("vote") == k, 1).otherwise(0)).cast("double") for k in range(n)]
    if key is None:
        return rows.agg(F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums]).alias(into))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*sums).alias(into))


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def identify(items: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text",
             markup_col: str = "markup", suffix_col: str = "suffix", host_col: str = "host", parent_col: str = "parent",
             temper: float = 0.1, alpha: float = 1.0, kappa: float = 20.0) -> DataFrame:
    """``row`` (the input row as a struct), ``language``, ``probability`` and ``text_language`` of every row.

    An empty table gives no rows.
    """
    langs, table = model
    n = len(langs)
    if not n:
        none = F.lit(None)
        return items.select(F.struct(*[c for c in items.columns if c != text_col]).alias("row"), none.cast("string").alias("language"),
                            none.cast("double").alias("probability"), none.cast("string").alias("text_language"))
    held = items.sparkSession.sparkContext.broadcast(table)  # languages x 65,536 numbers
    rows = items.select(F.struct(*[c for c in items.columns if c != text_col]).alias("row"),
                        F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    rows = rows.mapInArrow(_score(held), f"row {kind}, score array<double>, vote int")
    rows = stored(rows.select("*", *[F.col(f"row.{c}").alias(a) for a, c in (
        ("markup", markup_col), ("suffix", suffix_col), ("host", host_col), ("parent", parent_col))]), "scored")
    # The votes of all rows: one row.
    everything = _votes(rows, None, n, "all").first()["all"]
    shares = [(v + 1.0) / (sum(everything) + n) for v in everything]
    overall = F.array(*[F.lit(s) for s in shares])

    def smoothed(votes: Column, towards: Column) -> Column:
        return F.zip_with(votes, towards, lambda v, p: (v + kappa * p) / (_total(votes) + kappa))
    parents = _votes(rows, "parent", n, "votes").select(
        F.col("parent").alias("of"), smoothed(F.col("votes"), overall).alias("parent_prior"))
    hosts = rows.where("host is not null").groupBy("host").agg(
        F.max("parent").alias("of"),
        F.array(*[F.sum(F.when(F.col("vote") == k, 1).otherwise(0)).cast("double") for k in range(n)]).alias("host_votes"))
    # Stored, like the values below, so that the joins read plain exchanges and can split a hot key.
    hosts = stored(hosts.join(parents, "of", "left").select(
        "host", "host_votes", F.coalesce("parent_prior", overall).alias("parent_prior")), "hosts")
    known = F.array(*[F.lit(v + 0.0) for v in everything])
    given = {}
    for key in ("markup", "suffix"):
        values = stored(_votes(rows, key, n, "votes"), key)
        size = values.count()
        given[key] = values.select(key, F.zip_with("votes", known, lambda v, t: F.log(
            (v + alpha) / (t + alpha * (size + 1)))).alias(f"{key}_given"))
    out = rows.join(hosts, "host", "left").join(given["markup"], "markup", "left").join(given["suffix"], "suffix", "left")
    own = F.array(*[F.when(F.col("vote") == k, 1.0).otherwise(0.0) for k in range(n)])
    without = F.zip_with("host_votes", own, lambda a, b: a - b)
    prior = F.coalesce(smoothed(without, F.col("parent_prior")), overall)
    none = F.array_repeat(F.lit(0.0), n)
    terms = F.zip_with(F.zip_with(F.transform("score", lambda s: s * temper), prior, lambda s, p: s + F.log(p)),
                       F.zip_with(F.coalesce("markup_given", none), F.coalesce("suffix_given", none), lambda a, b: a + b),
                       lambda a, b: a + b)
    out = out.select("row", "vote", terms.alias("terms"))
    top = F.array_max("terms")
    names = F.array(*[F.lit(x) for x in langs])
    return out.select("row", F.element_at(names, F.array_position("terms", top).cast("int")).alias("language"),
                      (1 / _total(F.transform("terms", lambda t: F.exp(t - F.array_max("terms"))))).alias("probability"),
                      F.when(F.col("vote").isNotNull(), F.get(names, F.col("vote"))).alias("text_language"))


def page_items(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with text, markup, suffix, host and parent, as ``identify`` takes them."""
    from glosa.llm.line_dedup import host_of, lines_of
    host = F.nullif(host_of(F.col(url_col)), F.lit(""))
    markup = F.lower(F.regexp_extract(F.col(html_col), r"""(?is)<html\b[^<>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1))
    named = pages.select(F.struct("*").alias("page"), F.array_join(lines_of(F.col(html_col)), "\n").alias("text"),
                         F.nullif(markup, F.lit("")).alias("markup"), host.alias("host"))
    labels = F.split("host", r"\.", -1)
    return named.select("page", "text", "markup", F.when(F.size(labels) > 1, F.element_at(labels, -1)).alias("suffix"), "host",
                        F.when(F.size(labels) > 2, F.substring_index("host", ".", -2)).alias("parent"))
