"""The flagship's features split, rank and move a text once."""

from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, TEXT
from glosa.functions import registry as reg
from glosa.functions import text as tx
from glosa.operators import issues as iss
from glosa.operators.scoring import batch_scorer, seeded_text_classifier
from glosa.operators.style import StyleModel, scored_windows, seeded_style_model, word_table
from glosa.operators.words import word_counts, word_frequencies
from glosa.sources import lookups as lt

TEXTS = ["der Hund  ist da !! \U0001F600 \U0001F600 9️⃣ @USER", "", None, " \t ", "so so @medium aaa das das Photo .,",
         "ÄÖÜ 😀🎉 #1 (c) © und \"nich\" - x- y  \x1cz", "halt mal   ??"]


def _docs(spark):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    return spark.createDataFrame(rows, f"{COMMENT_ID} long, {TEXT} string")


def test_word_features_are_those_of_the_text(spark):
    names = ["NumWords", "AverageWordLength", "WordLengthStandardDeviation", "StopwordRatio", "NumUserAdressed", "NumMediumAdressed"]
    docs = _docs(spark)
    feats, layout = reg.build_features(docs, names + ["SpellingMistakes"])
    fns = [tx.num_words, tx.average_word_length, tx.word_length_std, tx.stopword_ratio, tx.num_user_addressed, tx.num_medium_addressed]
    want = docs.select(COMMENT_ID, *[f(F.col(TEXT)) for f in fns], *iss.issue_columns(F.col(TEXT)))
    assert sorted(map(repr, map(tuple, feats.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    plan = feats._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan.lower()


def test_rules_are_searched_only_where_they_can_match(spark):
    docs = _docs(spark)
    got = docs.select(*[c.alias(str(i)) for i, c in enumerate(iss.rule_counts(F.col(TEXT)))]).collect()
    want = docs.select(*[F.regexp_count(TEXT, F.lit(r.pattern)).alias(str(i)) for i, r in enumerate(iss.DEFAULT_RULES)]).collect()
    assert got == want and sum(r.holds != () for r in iss.DEFAULT_RULES) > 10


def test_emoji_are_those_of_the_whole_text(spark):
    docs = _docs(spark)
    whole = docs.select(F.regexp_extract_all(TEXT, F.lit(tx.EMOJI), F.lit(0)).alias("e")).collect()
    assert docs.select(tx.emoji_list(F.col(TEXT)).alias("e")).collect() == whole


def test_words_are_counted_where_they_lie(spark):
    docs = _docs(spark)
    freq = {r.token: r["_n"] for r in word_frequencies(docs, F.lower(F.col(TEXT))).collect()}
    plain = docs.select(F.explode(tx.tokens(F.lower(F.col(TEXT)))).alias("t")).groupBy("t").count().collect()
    assert freq == {r.t: r["count"] for r in plain}
    rows = word_counts(docs.where(f"{COMMENT_ID} in (1, 4)"), [COMMENT_ID], F.col(TEXT)).collect()
    assert sorted((r[0], r.token or "", r["_c"]) for r in rows) == [
        (1, "", 0), (4, ".,", 1), (4, "@medium", 1), (4, "Photo", 1), (4, "aaa", 1), (4, "das", 2), (4, "so", 2)]


def test_no_feature_holds_the_plan_of_another(spark):
    docs = _docs(spark)
    model = StyleModel(seeded_style_model(3), 3, lt.derived_word_vocab(docs), lt.derived_char_vocab(spark))
    assets = reg.FeatureAssets(scorers={"SentimentBERT": (batch_scorer(seeded_text_classifier(3), 3), 3)}, style=model,
                               polarity=lt.derived_polarity(docs), word_vectors=lt.derived_word_vectors(docs), word_vector_dim=3)
    feats, _ = reg.build_features(docs, ["SentimentTextBlob", "DocumentEmbeddingsFastTextPool", "SentimentBERT", "WritingStyleEmbeddings"], assets)
    plan = feats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # the sentiment model's cleaning
    assert feats.count() == len(TEXTS) + 1
    scored = scored_windows(docs, word_table(docs, model), model)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
