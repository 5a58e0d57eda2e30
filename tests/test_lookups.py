"""Lookup joins (broadcast vs salted), issue slots, windows, encodings, pooling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosa.operators import attention as att
from glosa.operators import issues as iss
from glosa.operators import joins as jn
from glosa.operators import lookups as lk
from glosa.operators import windows as win
from glosa.sources import lookups as lt
from glosa.sources.comments import comments

from conftest import SF001


@pytest.fixture(scope="module")
def docs(spark):
    return comments(spark, SF001).cache()


def _rows(df, key="comment_id"):
    return {r[key]: r for r in df.collect()}


def test_salted_join_equals_broadcast(docs):
    wv = lt.derived_word_vectors(docs)
    a = _rows(lk.pooled_word_vectors(docs, wv, 3, strategy="broadcast"))
    b = _rows(lk.pooled_word_vectors(docs, wv, 3, strategy="salted"))
    assert a.keys() == b.keys() and len(a) == docs.count()
    for k in a:
        assert np.allclose(a[k]["pooled"], b[k]["pooled"])
    pa = _rows(lk.lexicon_polarity(docs, lt.derived_polarity(docs), strategy="broadcast"))
    pb = _rows(lk.lexicon_polarity(docs, lt.derived_polarity(docs), strategy="salted"))
    assert all(math.isclose(pa[k]["polarity"], pb[k]["polarity"], abs_tol=1e-12) for k in pa)


@pytest.mark.parametrize("keys_held", [0, 1, 5, 1000])
def test_layered_join_is_a_left_join(spark, keys_held):
    """Whatever part of the table is broadcast: a hot key, a hot miss, rare keys, null keys, an empty table."""
    tokens = ["a"] * 200 + ["miss"] * 90 + ["b"] * 40 + ["c"] * 40 + ["d", "e", "rare miss"] + [None] * 60
    facts = spark.createDataFrame(list(enumerate(tokens)), "id long, token string")
    table = spark.createDataFrame([(t, float(i)) for i, t in enumerate("abcdef")], "token string, v double")
    for t in (table, table.limit(0)):
        want = facts.join(t, "token", "left").select("id", "token", "v")
        got = jn.layered_join(facts, t, "token", facts, max_broadcast_bytes=17 * keys_held).select("id", "token", "v")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_measured_size_counts_nested_vectors(spark):
    blocks = spark.createDataFrame([("ab", [[1.0] * 32] * 10), ("c", None)], "token string, v array<array<double>>")
    words = spark.createDataFrame([(["abc", None, "de"],)], "w array<string>")
    assert jn.measured_size(blocks) == (2, 10 + 16 + 10 * (16 + 32 * 8) + 9 + 16)
    assert jn.measured_size(words) == (1, 16 + 11 + 8 + 10)


def test_frequent_keys_stay_within_their_number(spark):
    tokens = ["a"] * 200 + ["b"] * 90 + ["c"] * 40 + ["d"] * 40 + ["e"]
    keys = spark.createDataFrame([(t,) for t in [*tokens, None]], "token string")
    held = {n: sorted(r.token for r in jn.frequent_keys(keys, "token", n).collect()) for n in range(6)}
    assert held == {0: [], 1: ["a"], 2: ["a", "b"], 3: ["a", "b"], 4: ["a", "b", "c", "d"], 5: ["a", "b", "c", "d", "e"]}


def test_hot_key_with_a_third_of_rows_is_salted(spark):
    n = 3000
    facts = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(n)], "id long, token string")
    table = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(n)], "token string, v double")
    hot = [r[0] for r in jn.hot_keys(facts, "token").collect()]
    assert hot == ["hot"]
    salted = jn.salted_join(facts, table, "token", salt_buckets=8, salt_cols=["id"])
    plain = facts.join(table, "token")
    assert sorted(map(tuple, salted.select("id", "token", "v").collect())) == \
        sorted(map(tuple, plain.select("id", "token", "v").collect()))
    # the hot key is spread over several salts
    spread = facts.join(jn.hot_keys(facts, "token"), "token").select(
        F.pmod(F.xxhash64("id"), F.lit(8)).alias("s")).distinct().count()
    assert spread > 1


def test_measured_size_counts_rows(spark):
    df = spark.createDataFrame([("ab", [1.0, 2.0]), ("c", [3.0])], "token string, vector array<double>")
    n, b = jn.measured_size(df)
    assert n == 2 and b > 0


def test_slot_map_first_match_quirk():
    assert iss.slot_of("PUNCTUATION", "DOPPELTES_AUSRUFEZEICHEN") == 3
    assert iss.slot_of("PUNCTUATION", "DE_DOUBLE_PUNCTUATION") == 3
    assert iss.slot_of("PUNCTUATION", "DOPPELTES_AUSRUFEZEICHEN", specific_first=True) == 16
    assert iss.slot_of("PUNCTUATION", "EINHEIT_LEERZEICHEN") is None
    assert iss.slot_of("TYPOGRAPHY", "MULTIPLICATION_SIGN") is None
    assert iss.slot_of("HILFESTELLUNG_KOMMASETZUNG", "X") == 6
    assert iss.slot_of("UNKNOWN", "X") is None


def test_slot_expr_agrees_with_slot_of(spark):
    cats = sorted({c for _, c, _, _ in iss.SLOT_RULES} | {"OTHER"})
    rules = ["X", "DE_DOUBLE_PUNCTUATION", "DOPPELTES_AUSRUFEZEICHEN", "EINHEIT_LEERZEICHEN",
             "TYPOGRAFISCHE_ANFUEHRUNGSZEICHEN"]
    df = spark.createDataFrame([(c, r) for c in cats for r in rules], "category string, rule_id string")
    for sf in (False, True):
        got = df.select("category", "rule_id", iss.slot_expr(F.col("category"), F.col("rule_id"), sf).alias("s"))
        for r in got.collect():
            assert r["s"] == iss.slot_of(r["category"], r["rule_id"], sf)


def test_issue_paths_agree(docs):
    a = _rows(iss.issue_counts(docs))
    b = _rows(iss.issue_counts_from_matches(docs, iss.rule_matches(docs)))
    for k in a:
        for c in iss.ISSUE_COLUMNS:
            assert a[k][c] == pytest.approx(b[k][c])


def _py_windows(text, w, hop):
    toks, out, n = text.split(), [], 0
    while toks[n:n + w]:
        out.append(" ".join(toks[n:n + w]))
        n += hop
    return out


def test_windows_match_python_loop(spark, docs):
    got = win.token_windows(docs, 7, 3).groupBy("comment_id").agg(
        F.sort_array(F.collect_list(F.struct("window_idx", "window"))).alias("w"))
    texts = {r[0]: r[1] for r in docs.collect()}
    for r in got.collect():
        assert [x["window"] for x in r["w"]] == _py_windows(texts[r["comment_id"]], 7, 3)
    empty = spark.createDataFrame([(1, "  ")], "comment_id long, c_text string")
    assert win.token_windows(empty, 7, 3).count() == 0


def test_hop_must_be_positive(docs):
    with pytest.raises(ValueError):
        win.token_windows(docs, 5, 0)


def test_vocab_and_char_encoding(spark):
    df = spark.createDataFrame([(1, "ab zz Ab")], "comment_id long, c_text string")
    vocab = spark.createDataFrame([("ab", 2), ("<UNK>", 1)], "token string, id int")
    enc = lk.vocab_encode(df, vocab, 2, 2, None).orderBy("window_idx", "pos").collect()
    assert [(r.window_idx, r.pos, r.word_id) for r in enc] == [(0, 0, 2), (0, 1, 1), (1, 0, 1)]
    ch = lk.char_encode(df, lt.derived_char_vocab(spark), 5, 5, None, 1).orderBy("pos").collect()
    assert [r.char_ids for r in ch] == [[2], [27], [1]]


def test_softmax_pool_matches_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(s), [float(x) for x in rng.standard_normal(3)])
            for g, s in zip(rng.integers(0, 3, 30), rng.standard_normal(30))]
    df = spark.createDataFrame(rows, "g int, s double, v array<double>")
    got = _rows(att.softmax_pool(df, "g", "s", "v"), "g")
    for g in got:
        s = np.array([r[1] for r in rows if r[0] == g])
        v = np.array([r[2] for r in rows if r[0] == g])
        w = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert np.allclose(got[g]["pooled"], w @ v)


def test_join_tokens(spark):
    df = spark.createDataFrame([([["a", "b"], [], ["c"]],)], "s array<array<string>>")
    assert df.select(win.join_tokens(F.col("s"))).first()[0] == "a b c"


def test_fused_token_lookups_equal_separate(docs):
    """Polarity and pooled vectors from one token pass equal the single-table runs."""
    wv, pol = lt.derived_word_vectors(docs), lt.derived_polarity(docs)
    both = _rows(lk.token_lookup_features(docs, word_vectors=wv, dim=3, lexicon=pol))
    alone_v = _rows(lk.pooled_word_vectors(docs, wv, 3))
    alone_p = _rows(lk.lexicon_polarity(docs, pol))
    assert set(both) == set(alone_v) == set(alone_p) == {r["comment_id"] for r in docs.collect()}
    for k, r in both.items():
        assert np.allclose(r["pooled"], alone_v[k]["pooled"])
        assert math.isclose(r["polarity"], alone_p[k]["polarity"], abs_tol=1e-12)


def test_char_encode_matches_python(spark):
    """Any alphabet size, repeated ids, whole or cut tokens: one plan, one result."""
    df = spark.createDataFrame([(1, "abz Ab\tä"), (1, "abz c"), (2, "😀a"), (3, None), (4, "")],
                               "comment_id long, c_text string")
    small = lt.derived_char_vocab(spark)
    big = small.unionByName(spark.createDataFrame([(chr(0x3400 + i), 1000 + i) for i in range(400)],
                                                  "token string, id int"))
    for vocab in (small, big):
        for cut in (None, 0, 2):
            got = sorted((r.comment_id, r.pos, r.char_ids) for r in lk.char_encode(df, vocab, 5, 5, max_chars=cut).collect())
            want = sorted((i, p, [ord(c) - 95 if "a" <= c <= "z" else 1 for c in t[:cut]])
                          for i, x in ((1, "abz Ab ä"), (1, "abz c"), (2, "😀a")) for p, t in enumerate(x.split()))
            assert got == want


def test_full_vocabulary_ranks(spark):
    df = spark.createDataFrame([(i, "b a a c") for i in range(3)] + [(9, "d b")], "comment_id long, c_text string")
    ids = {r.token: r.id for r in lt.derived_word_vocab(df.repartition(3)).collect()}
    assert ids == {"<UNK>": 1, "a": 2, "b": 3, "c": 4, "d": 5}
    assert {r.token for r in lt.derived_word_vocab(df, 2).collect()} == {"<UNK>", "a", "b"}


def test_windows_cap_is_an_option(spark):
    df = spark.createDataFrame([(1, " ".join(["w"] * 95)), (2, ""), (3, None)], "comment_id long, c_text string")
    rows = lk.window_lengths(df, 25, 20).orderBy("window_idx").collect()
    assert [(r.window_idx, r.n_words, r.n_windows) for r in rows] == [(0, 25, 5), (1, 25, 5), (2, 25, 5), (3, 25, 5), (4, 15, 5)]
    assert lk.window_lengths(df, 25, 20, max_windows=2).count() == 2
