"""Token lookups, chunk scores and style vectors: repeated and null ids, wide vectors, ragged windows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, TEXT
from glosa.functions import registry as reg
from glosa.operators import lookups as lk
from glosa.operators.attention import attention_two_level
from glosa.operators.scoring import batch_scorer, class_weights, seeded_text_classifier
from glosa.operators.style import StyleModel, encoded_windows, seeded_style_model, style_vectors, style_weights, word_table
from glosa.sources import lookups as lt

# Repeated ids with equal and other texts, null ids, null and empty texts.
ROWS = [(1, "aa bb"), (1, "aa bb"), (1, "bb cc cc"), (None, "aa"), (None, "cc dd"), (None, None), (2, ""), (3, None), (4, "zz"), (4, "Aa AA")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, f"{COMMENT_ID} long, {TEXT} string")


@pytest.mark.parametrize("strategy", ["broadcast", "salted", "layered"])
@pytest.mark.parametrize("dim", [1, 31, 32, 33, 300])
def test_pooled_vectors_of_repeated_and_null_ids(spark, rows, dim, strategy):
    table = {"aa": 1.0, "bb": 3.0, "cc": -2.0}
    wv = spark.createDataFrame([(t, [v * (d + 1) for d in range(dim)]) for t, v in table.items()], "token string, vector array<double>")
    pol = spark.createDataFrame([("bb", 0.5), ("dd", -1.0)], "token string, polarity double")
    out = lk.token_lookup_features(rows, word_vectors=wv, dim=dim, lexicon=pol, strategy=strategy)
    got = sorted((str(r[COMMENT_ID]), tuple(round(x, 9) for x in r.pooled), r.polarity) for r in out.collect())

    def want(text):
        toks = (text or "").lower().split()
        mean = sum(table.get(t, 0.0) for t in toks) / len(toks) if toks else 0.0
        hits = [{"bb": 0.5, "dd": -1.0}[t] for t in toks if t in ("bb", "dd")]
        return tuple(round(mean * (d + 1), 9) for d in range(dim)), sum(hits) / len(hits) if hits else 0.0
    assert got == sorted((str(i), *want(t)) for i, t in ROWS)


def test_texts_move_once(spark, rows):
    """Token counts and block sums find a text's rows where its one shuffle put them."""
    wv = spark.createDataFrame([("aa", [1.0] * 40)], "token string, vector array<double>")
    found = lk.token_lookup_results(rows, word_vectors=wv, dim=40, strategy="broadcast")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_no_wide_aggregate(spark, rows):
    """300 dimensions: a few sums of a block, not 300."""
    wv = spark.createDataFrame([("aa", [1.0] * 300)], "token string, vector array<double>")
    plan = lk.pooled_word_vectors(rows, wv, 300, strategy="broadcast")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum(") <= 4 * lk.BLOCK_DIMS


def test_registry_features_keep_their_rows(spark, rows):
    wv = spark.createDataFrame([("aa", [1.0, 2.0])], "token string, vector array<double>")
    pol = spark.createDataFrame([("bb", 0.5)], "token string, polarity double")
    assets = reg.FeatureAssets(word_vectors=wv, word_vector_dim=2, polarity=pol,
                               scorers={"SentimentBERT": (batch_scorer(seeded_text_classifier(3), 3), 3)},
                               style=StyleModel(seeded_style_model(4), 4, lt.derived_word_vocab(rows), lt.derived_char_vocab(spark)))
    for names in (["DocumentEmbeddingsFastTextPool", "SentimentTextBlob"], ["SentimentTextBlob"], ["DocumentEmbeddingsFastTextPool"],
                  ["SentimentBERT", "WritingStyleEmbeddings"]):
        feats, layout = reg.build_features(rows, names, assets)
        out = feats.collect()
        assert len(out) == len(ROWS)
        assert all(r[c] is not None for r in out for c in [*layout.numerical, *[c for c, _ in layout.embeddings]])
    feats, layout = reg.build_features(rows, ["SentimentBERT"], assets)
    w = class_weights(3)
    got = sorted((str(r[COMMENT_ID]), tuple(round(r[c], 9) for c in layout.numerical)) for r in feats.collect())
    from glosa.functions.text import clean_text
    cleaned = [(r[0], r[1]) for r in rows.select(COMMENT_ID, clean_text(F.col(TEXT))).collect()]
    text = [(i, " ".join(x for x in (t or "").split(" ") if x)) for i, t in cleaned]
    want = [(str(i), tuple(round(float(v), 9) + 0.0 for v in np.array([len(t), t.count(" "), t.count("e"), t.count("n")]) / 100.0 @ w)) for i, t in text]
    assert [g[0] for g in got] == [x[0] for x in sorted(want)]
    assert np.allclose([g[1] for g in got], [x[1] for x in sorted(want)])


def test_style_vectors_use_every_window(spark):
    """Against windows cut, encoded and pooled in Python; words of very uneven lengths fall into other buckets."""
    texts = ["", " ".join(f"w{i}" for i in range(60)), "x" * 90 + " kurz", "a b c", " ".join(["lang" * 12] * 30), None, "ÄÖ ß1"]
    df = spark.createDataFrame(list(enumerate(texts)), f"{COMMENT_ID} long, {TEXT} string")
    vocab = lt.derived_word_vocab(df)
    model = StyleModel(seeded_style_model(5), 5, vocab, lt.derived_char_vocab(spark), window=7, hop=5)
    ids = {r.token: r.id for r in vocab.collect()}
    w = style_weights(5)
    got = {r[COMMENT_ID]: r.style for r in style_vectors(df, model).collect()}
    for i, t in enumerate(texts):
        toks, outs = (t or "").split(), []
        for start in range(0, len(toks), 5):
            part = toks[start: start + 7]
            chars = sum(ord(c) - 95 if "a" <= c <= "z" else 1 for x in part for c in x)
            x = np.array([sum(ids.get(x, 1) for x in part), chars, sum(map(len, part)), len(part)]) / 10_000.0
            outs.append(x @ w)
        want = np.zeros(5)
        if outs:
            s = np.array([o[0] for o in outs])
            e = np.exp(s - s.max())
            want = sum(a * o[1:] for a, o in zip(e, outs)) / e.sum()
        assert np.allclose(got[i], want, atol=1e-9)
    windows = encoded_windows(df, word_table(df, model), model)
    assert windows.count() == sum(-(-len((t or "").split()) // 5) for t in texts)


def test_two_level_attention(spark):
    """Ragged windows, a document of one window, one with a masked word (no row), and a long one, split by salts."""
    rng = np.random.default_rng(2)
    rows = [(d, w, float(rng.normal()), [float(v) for v in rng.normal(size=3)])
            for d, n in ((1, 1), (2, 4), (3, 300)) for w in range(n) for _ in range(1 + (w * 7 + d) % 5)]
    items = spark.createDataFrame(rows, "doc long, window int, score double, vector array<double>")
    context = [0.5, -1.0, 0.25]

    def pool(scores, vectors):
        e = np.exp(np.array(scores) - max(scores))
        return (e[:, None] * np.array(vectors)).sum(axis=0) / e.sum()
    for strategy in ("broadcast", "salted"):
        got = {r.doc: r.pooled for r in attention_two_level(items, "doc", "window", "score", "vector", context, strategy=strategy).collect()}
        assert set(got) == {1, 2, 3}
        for d in got:
            ws = [pool([r[2] for r in rows if r[:2] == (d, w)], [r[3] for r in rows if r[:2] == (d, w)]) for w in sorted({r[1] for r in rows if r[0] == d})]
            assert np.allclose(got[d], pool([float(v @ context) for v in ws], ws), atol=1e-9)
    assert math.isclose(sum(got[1]), sum(pool([r[2] for r in rows if r[0] == 1], [r[3] for r in rows if r[0] == 1])), abs_tol=1e-9)
