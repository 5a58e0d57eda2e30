"""The flagship run on the generated tables: every feature family, seven
stratified folds, a seeded model search per fold, out-of-fold metrics and the
fold-ensemble vote on the unlabelled comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glosa.columns import COMMENT_ID
from glosa.functions.registry import FeatureAssets
from glosa.operators.scoring import batch_scorer, seeded_text_classifier
from glosa.operators.style import StyleModel, seeded_style_model
from glosa.plans.pipeline import RunConfig, RunResult, run
from glosa.sources import lookups as lt
from glosa.sources.comments import comments_view, labelled_view, load_table, spread

# The all-features list with pooled vectors and lexicon polarity in addition. No weights
# ship with the data: document vectors come from the ``embeddings`` table, the sentiment and
# style models are seeded stand-ins with the real ones' inputs and widths.
FLAGSHIP_FEATURES = [
    "DocumentEmbeddingsBERT", "WritingStyleEmbeddings", "DocumentEmbeddingsFastTextPool", "SentimentBERT", "SentimentTextBlob",
    "SpellingMistakes", "WordLengthStandardDeviation", "AverageWordLength", "NumWords", "NumCharacters", "StopwordRatio",
    "ExclamationMarkRatio", "NumReferences", "NumMediumAdressed", "NumUserAdressed", "AverageEmojiRepetition",
]
STYLE_DIM = 100
WORD_DIM = 300
FLAGSHIP_TRIALS = 100

# The feature lists of the three run configs (7 folds, 100 trials
# a fold, random state 42).
RUN_FEATURES = {
    "all-features": [
        "DocumentEmbeddingsBERT", "WritingStyleEmbeddings", "SentimentBERT", "SpellingMistakes",
        "WordLengthStandardDeviation", "AverageWordLength", "NumWords", "NumCharacters", "StopwordRatio",
        "ExclamationMarkRatio", "NumReferences", "NumMediumAdressed", "NumUserAdressed", "AverageEmojiRepetition"],
    "baseline-bert": ["DocumentEmbeddingsBERT"],
    "baseline-fasttext": ["DocumentEmbeddingsFastTextPool"],
}


def run_config(name: str, num_trials: int = 100) -> RunConfig:
    return RunConfig(name=name, features=RUN_FEATURES[name], num_splits=7, num_trials=num_trials, random_state=42)


_RUNS: dict[tuple, RunResult] = {}


def stand_in_style(spark: SparkSession, comments: DataFrame, dim: int = STYLE_DIM) -> StyleModel:
    return StyleModel(seeded_style_model(dim), dim, lt.derived_word_vocab(comments), lt.derived_char_vocab(spark), name="seeded")


def flagship_inputs(spark: SparkSession, sf_dir: str, word_dim: int = 3,
                    features: list[str] = FLAGSHIP_FEATURES) -> tuple[DataFrame, DataFrame, FeatureAssets]:
    """Train and test comments, and the tables that ``features`` read; others are not derived."""
    docs = load_table(spark, sf_dir, "documents")
    labels = load_table(spark, sf_dir, "labels")
    comments = spread(comments_view(docs))
    train = labelled_view(docs, labels)
    test = comments.join(labels.select(labels.doc_id.alias(COMMENT_ID)), COMMENT_ID, "left_anti")
    vectors = lt.doc_vectors_from_embeddings(load_table(spark, sf_dir, "embeddings"))
    dim = len(vectors.select("vector").first()[0])
    assets = FeatureAssets(word_vector_dim=word_dim, scorers={"SentimentBERT": (batch_scorer(seeded_text_classifier(3), 3), 3)},
                           doc_vectors={"DocumentEmbeddingsBERT": (vectors, dim)})
    if {"DocumentEmbeddingsFastTextPool", "SentimentTextBlob", "WritingStyleEmbeddings"} & {*features}:
        comments = lt.stored_words(comments)  # the tables below read no more of the texts
    if "DocumentEmbeddingsFastTextPool" in features:
        assets.word_vectors = lt.derived_word_vectors(comments) if word_dim == 3 else lt.derived_wide_vectors(comments, word_dim)
    if "SentimentTextBlob" in features:
        assets.polarity = lt.derived_polarity(comments)
    if "WritingStyleEmbeddings" in features:
        assets.style = stand_in_style(spark, comments)
    return train, test, assets


def flagship_run(spark: SparkSession, sf_dir: str, num_trials: int = FLAGSHIP_TRIALS) -> RunResult:
    key = (spark.sparkContext.applicationId, sf_dir, num_trials)
    if key not in _RUNS:
        train, test, assets = flagship_inputs(spark, sf_dir)
        cfg = RunConfig(name="all-features", features=FLAGSHIP_FEATURES, num_splits=7, num_trials=num_trials,
                        random_state=42)
        _RUNS[key] = run(spark, train, test, cfg, assets)
    return _RUNS[key]


def config_run(spark: SparkSession, sf_dir: str, name: str, num_trials: int = FLAGSHIP_TRIALS) -> RunResult:
    """One of the run configs as it stands, with word vectors of their full width."""
    key = (spark.sparkContext.applicationId, sf_dir, name, num_trials)
    if key not in _RUNS:
        train, test, assets = flagship_inputs(spark, sf_dir, WORD_DIM, RUN_FEATURES[name])
        _RUNS[key] = run(spark, train, test, run_config(name, num_trials), assets)
    return _RUNS[key]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-fold, per-task validation metrics of the cross-validated run."""
    return flagship_run(spark, sf_dir).cv.metrics
