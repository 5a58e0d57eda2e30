"""F2, F3 of round 4: word vectors beyond a broadcast, on rows of their own."""

import numpy as np
import pytest

from glosa.operators import lookups as lk
from glosa.sources import lookups as lt

DOCS = [(1, "aa bb aa cc dd"), (1, "aa bb aa cc dd"), (2, "bb " * 30 + "ee"), (3, ""), (4, None), (None, "ff aa gg zz"), (None, "ff aa gg zz"),
        (5, "QQ qq"), (6, " \t ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "comment_id long, c_text string")


@pytest.mark.parametrize("held,pairs", [(0, 1), (1, 3), (200_000, 250_000)])
@pytest.mark.parametrize("fused", [False, True])
def test_sums_of_a_large_table_are_those_of_a_broadcast(spark, docs, monkeypatch, held, pairs, fused):
    """repeated rows, null ids, repeated and null table words, short, null and missing vectors; no vector by text and word."""
    rng = np.random.default_rng(1)

    def vector():
        return [float(x) for x in rng.normal(size=40)]
    rows = [(t, vector()) for t in ["aa", "bb", "cc", "ee", "ff", "aa", "qq"]] + [("dd", None), (None, vector()), ("gg", [1.0, None])]
    vectors = spark.createDataFrame(rows, "token string, vector array<double>")
    lexicon = spark.createDataFrame([("aa", 1.0), ("cc", None), ("ee", -0.5), ("zz", 0.25), ("zz", 0.5)], "token string, polarity double") if fused else None

    def found(strategy):
        out = lk.token_lookup_features(docs, word_vectors=vectors, dim=40, lexicon=lexicon, strategy=strategy).collect()
        return sorted((repr(r.comment_id), [round(x, 9) for x in r.pooled], round(r.polarity, 9) if fused else None) for r in out)
    want = found("broadcast")
    monkeypatch.setattr(lk, "HELD_WORDS", held)
    monkeypatch.setattr(lk, "FAR_PAIRS", pairs)
    monkeypatch.setattr(lk, "layered_join", None)
    assert found("layered") == want and len(want) == len(DOCS)


def test_numbers_are_narrowed_only_if_none_changes(spark):
    blocks = "token string, _blocks array<array<double>>"
    exact = spark.createDataFrame([("a", [[0.5, None], [float("nan")]]), ("b", None)], blocks)
    other = spark.createDataFrame([("a", [[0.5], [0.1]])], blocks)
    assert lk._narrowest(exact).schema["_blocks"].dataType.simpleString() == "array<array<float>>"
    assert lk._narrowest(other).schema["_blocks"].dataType.simpleString() == "array<array<double>>"


def test_wide_vectors_follow_their_formula(spark):
    words = spark.createDataFrame([("wort Öde eee ab 😀😀e",)], "c_text string")
    got = {r.token: r.vector for r in lt.derived_wide_vectors(words, 40).collect()}
    assert got == {t: [float((len(t) * (d + 1) + t.find("e") + 1) % 13 - 6) for d in range(40)] for t in ("wort", "öde", "eee", "😀😀e")}
