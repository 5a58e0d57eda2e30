"""Micro golden rows (raw values before ln(x + 1e-9)) and text-feature quirks."""

import math

import pytest
from pyspark.sql import functions as F

from glosa.functions import text as tx

STOP = ["und", "der", "das", "ist", "nicht", "so"]
ROWS = [
    (1, "@USER Das ist super!! \U0001F600\U0001F600\U0001F389 https://a.de/x?1"),
    (2, "@MEDIUM,  und nicht\tso  @user @User !"),
    (3, "httx http://b.de htt\nfoo 3x7"),
    (4, "aa bb cc"),
    (5, "und und der"),
    (6, "!"),
    (7, "ab cde\xa0f"),
    (8, "Straße 10\tkm @x, HTTPS://C.de Über 2021"),
]
# id: chars, words, mean len, std len, @user, @medium, refs, ! ratio, stop ratio, emoji rep, cleaned
GOLDEN = {
    1: (42, 6, 6.166667, 4.633813, 1, 0, 1, 0.047619, 0.333333, 1.5, "das ist super"),
    2: (37, 7, 4.142857, 2.166536, 2, 0, 0, 0.027027, 0.428571, 0, "und nichtso"),
    3: (28, 5, 4.8, 3.1241, 0, 0, 2, 0, 0, 0, "httx htt foo dreix sieben"),
    4: (8, 3, 2, 0, 0, 0, 0, 0, 0, 0, "aa bb cc"),
    5: (11, 3, 3, 0, 0, 0, 0, 0, 1, 0, "und und der"),
    6: (1, 1, 1, 0, 0, 0, 0, 1, 0, 0, ""),
    7: (8, 3, 2, 0.816497, 0, 0, 0, 0, 0, 0, "ab cdef"),
    8: (39, 7, 4.714286, 3.238795, 0, 0, 0, 0, 0, 0, "straße eins nullkm httpscde über zwei null zwei eins"),
}


@pytest.fixture(scope="module")
def features(spark):
    df = spark.createDataFrame(ROWS, "id long, t string")
    t = F.col("t")
    out = df.select("id", tx.num_characters(t).alias("chars"), tx.num_words(t).alias("words"),
                    tx.average_word_length(t).alias("mean"), tx.word_length_std(t).alias("std"),
                    tx.num_user_addressed(t).alias("user"), tx.num_medium_addressed(t).alias("medium"),
                    tx.num_references(t).alias("refs"), tx.exclamation_ratio(t).alias("bang"),
                    tx.stopword_ratio(t, STOP).alias("stop"), tx.average_emoji_repetition(t).alias("emoji"),
                    tx.clean_text(t).alias("cleaned"))
    return {r["id"]: r for r in out.collect()}


def raw(v):
    return math.exp(v) - 1e-9


@pytest.mark.parametrize("rid", sorted(GOLDEN))
def test_golden_row(features, rid):
    g = GOLDEN[rid]
    r = features[rid]
    logged = ["chars", "words", "mean", "std", "user", "medium", "refs"]
    for name, want in zip(logged, g[:7]):
        assert raw(r[name]) == pytest.approx(want, abs=2e-6), name
    assert r["bang"] == pytest.approx(g[7], abs=2e-6)
    assert raw(r["stop"]) == pytest.approx(g[8], abs=2e-6)
    assert raw(r["emoji"]) == pytest.approx(g[9], abs=2e-6)
    assert r["cleaned"] == g[10]


def test_null_text_gives_null(spark):
    df = spark.createDataFrame([(1, None)], "id long, t string")
    t = F.col("t")
    r = df.select(tx.num_words(t).alias("w"), tx.average_word_length(t).alias("m"),
                  tx.average_emoji_repetition(t).alias("e"), tx.clean_text(t).alias("c")).first()
    assert r["w"] is None and r["m"] is None and r["e"] is None and r["c"] is None


def test_blank_text_ratio_is_null(spark):
    df = spark.createDataFrame([(1, "   ")], "id long, t string")
    t = F.col("t")
    r = df.select(tx.average_word_length(t).alias("m"), tx.word_length_std(t).alias("s"),
                  tx.stopword_ratio(t).alias("r"), tx.num_words(t).alias("w")).first()
    assert r["m"] is None and r["s"] is None and r["r"] is None
    assert r["w"] == pytest.approx(math.log(1e-9))


def test_python_whitespace_split(spark):
    # every code point str.isspace() accepts splits, like Python str.split()
    ws = [c for c in map(chr, range(0x3001)) if c.isspace()]
    text = "a" + "a".join(ws) + "a"
    r = spark.createDataFrame([(text,)], "t string").select(F.size(tx.tokens(F.col("t"))).alias("n")).first()
    assert r["n"] == len(text.split())


def test_reference_pattern_counts_httx_not_uppercase(spark):
    df = spark.createDataFrame([("httx HTTP://x http htt",)], "t string")
    r = df.select(tx.num_references(F.col("t")).alias("r")).first()
    assert raw(r["r"]) == pytest.approx(2)  # httx, http ; HTTP and bare htt do not count
