"""Work and files that grow with the input only: plans and copies, on rows of their own."""

import time

import pytest
from pyspark.sql import functions as F

from glosa.operators import lookups as lk
from glosa.operators import windows as win
from glosa.operators.attention import softmax_pool
from glosa.operators.style import StyleModel, encoded_windows, seeded_style_model, window_outputs, word_table
from glosa.session import cut_lineage
from glosa.sources import lookups as lt


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "aa bb aa cc"), (2, "bb " * 30), (3, ""), (4, None)], "comment_id long, c_text string")


def test_windows_of_a_long_text_take_linear_time(spark):
    """No copy of the whole text's tokens for each window (60,000 tokens, a window each)."""
    long = spark.createDataFrame([(1, 60_000)], "comment_id long, n int").select("comment_id", F.expr("repeat('w ', n)").alias("c_text"))
    began = time.time()
    assert win.token_windows(long, 2, 1).agg(F.count("window_tokens")).first()[0] == 60_000
    assert lk.window_lengths(long, 2, 1).agg(F.sum("n_words")).first()[0] == 119_999
    assert lk.window_token_rows(long, 2, 1, None).count() == 119_999
    assert time.time() - began < 40
    assert "slice(" not in _plan(win.token_windows(long, 2, 1))


@pytest.mark.parametrize("window,hop,most", [(7, 3, None), (2, 5, None), (5, 5, 2), (3, 1, 4)])
def test_window_rows_are_those_of_the_windows(docs, window, hop, most):
    cut = win.token_windows(docs, window, hop, most).select("comment_id", "window_idx", F.posexplode("window_tokens").alias("pos", "token"))
    rows = lk.window_token_rows(docs, window, hop, most)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, cut.collect()))


def test_characters_are_encoded_without_a_shuffle(spark, docs):
    """tokens stay where they are."""
    plan = lk.char_encode(docs, lt.derived_char_vocab(spark), 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_pooling_joins_nothing_and_bears_any_score(spark):
    """items are read once; scores far apart neither overflow nor vanish."""
    items = spark.createDataFrame([("a", 900.0, [1.0] * 40), ("a", 899.0, [3.0] * 40), ("a", -900.0, [9.0] * 40), ("b", -2000.0, [5.0] * 40),
                                   (None, 1.0, [7.0] * 40)], "g string, s double, v array<double>")
    e = 2.718281828459045
    for dim in (None, 40):
        out = softmax_pool(items, "g", "s", "v", dim=dim)
        assert "Join" not in _plan(out)
        got = {r.g: r.pooled for r in out.collect()}
        assert set(got) == {"a", "b"}
        assert got["a"] == pytest.approx([(e + 3) / (e + 1)] * 40) and got["b"] == pytest.approx([5.0] * 40)


def test_style_windows_are_not_exploded_to_words(spark, docs):
    """F1: windows come from the text, not from grouped word rows, and all buckets are scored in one pass."""
    model = StyleModel(seeded_style_model(3), 3, lt.derived_word_vocab(docs), lt.derived_char_vocab(spark), window=7, hop=5)
    out = window_outputs(encoded_windows(docs, word_table(docs, model), model), model)
    plan = _plan(out)
    assert "Union" not in plan and plan.count("MapInArrow") == 2
    assert out.count() == 7


def test_rare_words_come_back_to_their_text(spark, docs, monkeypatch):
    """the same windows whether a word is sent to all tasks or looked up."""
    import glosa.operators.style as st
    model = StyleModel(seeded_style_model(3), 3, lt.derived_word_vocab(docs), lt.derived_char_vocab(spark), window=7, hop=5)

    def windows():
        return sorted((r.key.id, r.window_idx, r.word_ids, r.char_ids, r.lengths)
                      for r in encoded_windows(docs, word_table(docs, model), model).collect())
    with_all = windows()
    monkeypatch.setattr(st, "FREQUENT_WORDS", 0)
    assert windows() == with_all and with_all[0][2] == [3, 2, 3, 4]


def test_a_large_lexicon_is_looked_up_in_layers(spark, docs, monkeypatch):
    """beyond the broadcast cap, only rarer tokens meet the table in a shuffle."""
    lexicon = spark.createDataFrame([("aa", 1.0), ("bb", -0.5)], "token string, polarity double")
    called, layered = [], lk.layered_join
    monkeypatch.setattr(lk, "fits_broadcast", lambda *a: False)
    monkeypatch.setattr(lk, "layered_join", lambda *a, **k: called.append(1) or layered(*a, **k))
    got = {r.comment_id: r.polarity for r in lk.lexicon_polarity(docs, lexicon).collect()}
    assert got == {1: 0.5, 2: -0.5, 3: 0.0, 4: 0.0}
    ids = {r.token: r.word_id for r in lk.vocab_encode(docs, lt.derived_word_vocab(docs), 3, 2).collect()}
    assert ids == {"bb": 2, "aa": 3, "cc": 4} and len(called) == 2


def test_a_stored_vector_table_is_small(spark):
    """2,000 vectors of 300 numbers take less than a tenth of their width on disk."""
    import os
    words = spark.range(2000).select(F.concat(F.lit("wort"), F.col("id").cast("string")).alias("c_text"))
    table = lt.derived_wide_vectors(words, 300)
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in table.inputFiles())
    assert table.count() == 2000 and 0 < size < 2000 * 300 * 8 / 10
    assert cut_lineage(table).inputFiles()


def test_only_read_tables_are_derived(spark):
    """a configuration's features decide which lookup tables are made."""
    from glosa.plans.flagship import RUN_FEATURES, flagship_inputs
    from conftest import SF001
    assets = flagship_inputs(spark, SF001, 300, RUN_FEATURES["baseline-bert"])[2]
    assert assets.word_vectors is None and assets.polarity is None and assets.style is None
