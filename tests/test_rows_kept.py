"""No row is lost: null labels, missing vectors, user features, long texts, emoji sequences."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, FOLD, LABELS, TEXT
from glosa.functions import registry as reg
from glosa.functions import text as tx
from glosa.operators import folds as fo
from glosa.operators.scoring import model_input_chunks
from glosa.operators.tuning import _score_trials, search_space, tune_fold
from glosa.plans.flagship import flagship_inputs
from glosa.plans.pipeline import RunConfig, predict_ensemble, run
from glosa.sources import lookups as lt

from conftest import SF001


def test_null_labels_and_ids_keep_their_rows(spark):
    rows = [(str(i), f"t {i}", i % 2, (i // 2) % 2, (i // 4) % 2) for i in range(16)]
    rows += [("x", "t", None, 1, 0), (None, "t", 1, 0, 1), ("y", None, None, None, None)]
    df = spark.createDataFrame(rows, "comment_id string, c_text string, " + ", ".join(f"{c} int" for c in LABELS))
    out = fo.assign_folds(df, k=3).collect()
    assert len(out) == len(rows)
    assert {r.comment_id for r in out if r[FOLD] is None} == {"x", "y"}
    coded = {r.comment_id: r.class_id for r in fo.multilabel_to_multiclass(df).collect()}
    assert coded["x"] is None and sorted(v for v in coded.values() if v is not None)[-1] == 7


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    train, test, assets = flagship_inputs(spark, SF001)
    half = train.withColumn(LABELS[0], F.when(F.col(COMMENT_ID) % 10 != 3, F.col(LABELS[0])))
    cfg = RunConfig(name="kept", features=["DocumentEmbeddingsBERT", "NumWords", "NumCharacters"], num_splits=3,
                    num_trials=2, random_state=1)
    vecs, dim = assets.doc_vectors["DocumentEmbeddingsBERT"]
    assets.doc_vectors["DocumentEmbeddingsBERT"] = (vecs.where(F.col(COMMENT_ID) % 2 == 0), dim)
    out = str(tmp_path_factory.mktemp("run"))
    return run(spark, half, test, cfg, assets, out_dir=out), half, test, out, assets, cfg


def test_every_row_is_fitted_and_predicted(result):
    r, train, test, *_ = result
    labelled = train.where(F.col(LABELS[0]).isNotNull())
    assert r.cv.oof.count() == labelled.count() and r.cv.incomplete_rows > 0
    assert r.unlabelled_rows == train.count() - labelled.count() > 0
    assert r.predictions.count() == test.count()
    assert r.predictions.where(" OR ".join(f"{c} IS NULL OR {c} NOT IN (0, 1)" for c in LABELS)).count() == 0


def test_affine_weights_equal_the_pipelines(result, spark):
    r, train, test, _, assets, cfg = result
    feats, layout = reg.build_features(test, cfg.features, assets)
    rows = reg.assemble(feats, layout).select(COMMENT_ID, "num", "emb")
    votes = None
    for k, m in r.cv.models.items():
        p = m.predict(rows).select(COMMENT_ID, *[F.col(c).alias(f"{c}_{k}") for c in m.pred_cols])
        votes = p if votes is None else votes.join(p, COMMENT_ID)
    want = {v[0]: tuple(int(2 * sum(v[f"pred_{t}_{k}"] for k in r.cv.models) >= len(r.cv.models)) for t in range(3))
            for v in votes.collect()}
    got = {v[0]: tuple(v[c] for c in LABELS) for v in predict_ensemble(feats, layout, r.cv.models).collect()}
    assert got == want


def test_run_writes_its_files(result, spark):
    from pyspark.ml import PipelineModel
    r, _, test, out, *_ = result
    sub = spark.read.csv(f"{out}/submissions/submission", header=True)
    assert sub.columns == [COMMENT_ID, *LABELS] and sub.count() == test.count()
    assert sub.where(" OR ".join(f"{c} IS NULL" for c in LABELS)).count() == 0
    assert spark.read.parquet(f"{out}/metrics").count() == 9 and spark.read.parquet(f"{out}/importance").count() > 0
    assert len(PipelineModel.load(f"{out}/models/fold=0").stages) == len(r.cv.models[0].pipeline().stages)


def test_a_hundred_trials_are_fitted_and_scored_together(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(6)], i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "comment_id long, e array<double>, fold int")
    for t, c in enumerate(LABELS):
        df = df.withColumn(c, (F.col("e")[t] + 0.3 * F.col("e")[t + 1] > 0).cast("int"))
    layout = reg.FeatureLayout([], [("e", 6)], [f"e{i}" for i in range(6)], ["embedding"] * 6)
    data = reg.assemble(df, layout)
    trials = search_space(100, 6, 3)
    s = tune_fold(fo.train_rows(data, 0), fo.valid_rows(data, 0), layout, trials)
    assert len(s.scores) == 100 and s.passes < 100 and max(x[3] for x in s.scores) > 0.8
    # The best trial's score again, from its pipeline's predictions.
    pred = s.model.predict(fo.valid_rows(data, 0).select("emb", *LABELS)).collect()
    f1 = []
    for t, c in enumerate(LABELS):
        tp, wrong = sum(r[c] and r[f"pred_{t}"] for r in pred), sum(r[c] != r[f"pred_{t}"] for r in pred)
        f1.append(2 * tp / (2 * tp + wrong))
    assert math.isclose(max(x[3] for x in s.scores), sum(f1) / 3, abs_tol=1e-9)
    assert _score_trials(s.model.shared.model.transform(fo.valid_rows(data, 0)), s.model.shared,
                         {s.best.idx: s.model.regressions}, [s.best], LABELS)[s.best.idx] == pytest.approx(sum(f1) / 3)


def test_user_features_keep_their_columns(spark):
    specs = [reg.FeatureSpec("MyEmb", "embedding", lambda a: 2, columns=lambda t, a: [F.array(
                 F.length(t).cast("double"), F.lit(1.0)).alias("e_MyEmb")], names=lambda a: ["e0", "e1"]),
             reg.FeatureSpec("Own", "numerical", lambda a: 1, columns=lambda t, a: [F.length(t).cast("double").alias("own")]),
             reg.FeatureSpec("Wrong", "numerical", lambda a: 2, columns=lambda t, a: [F.lit(1.0).alias("w")])]
    df = spark.createDataFrame([(1, "abc"), (2, None)], f"{COMMENT_ID} long, {TEXT} string")
    try:
        for s in specs:
            reg.register_feature(s)
        feats, layout = reg.build_features(df, ["Own", "MyEmb"])
        assert layout.width == len(layout.names) == 3 and layout.numerical == ["own"]
        rows = {r[COMMENT_ID]: (r.num.toArray().tolist(), r.emb.toArray().tolist())
                for r in reg.assemble(feats, layout).collect()}
        assert rows[1] == ([3.0], [3.0, 1.0]) and rows[2][0] == [0.0]
        meta = reg.assemble(feats, layout).schema["emb"].metadata["ml_attr"]
        assert meta["num_attrs"] == 2
        with pytest.raises(ValueError, match="Wrong"):
            reg.build_features(df, ["Wrong"])
    finally:
        for s in specs:
            reg.REGISTRY.pop(s.name, None)


def test_sentiment_scores_read_the_whole_text(spark):
    long = " ".join(["wort"] * 600 + ["ende"] * 424)
    df = spark.createDataFrame([(1, long), (2, ""), (3, None)], f"{COMMENT_ID} long, {TEXT} string")
    chunks = {r[0]: [len(c.split()) for c in r.c] for r in df.select(COMMENT_ID, model_input_chunks(F.col(TEXT)).alias("c")).collect()}
    assert chunks == {1: [512, 512], 2: [0], 3: [0]}
    assets = reg.FeatureAssets(scorers={"SentimentBERT": (lambda c: F.array(
        (F.length(c) - F.length(F.replace(c, F.lit("ende"), F.lit("")))).cast("double"), F.lit(1.0)), 2)})
    feats, layout = reg.build_features(df, ["SentimentBERT"], assets)
    got = {r[COMMENT_ID]: [r[c] for c in layout.numerical] for r in feats.collect()}
    assert got == {1: [424 * 4 / 2, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}


@pytest.mark.parametrize("text,mean", [("⭐⭐⭐", 3), ("⏰", 1), ("👍🏽👍🏽 👍", 1.5), ("🇩🇪🇩🇪 🇫🇷", 1.5), ("👨‍👩‍👧 👨‍👩‍👧", 2), ("1️⃣ 1", 1), ("a b", 0),
                                       ("😀😀🎉", 1.5), ("❤️❤️", 2)])
def test_emoji_symbols(spark, text, mean):
    got = spark.createDataFrame([(text,)], "t string").select(tx.average_emoji_repetition(F.col("t"))).first()[0]
    assert math.isclose(got, math.log(mean + 1e-9), abs_tol=1e-9)


def test_constants_of_text_features():
    """Literals, so that the oracles and the features cannot share a mistake."""
    assert tx.DEFAULT_STOPWORDS == ["und", "der", "das", "ist", "nicht", "so"]
    assert "".join(w for _, w in tx.DIGIT_WORDS) == " null eins zwei drei vier fünf sechs sieben acht neun"
    assert [d for d, _ in tx.DIGIT_WORDS] == list("0123456789")
    assert lt.UNK == "<UNK>"


def test_run_configs():
    from glosa.plans.flagship import RUN_FEATURES, run_config
    widths = {n: reg.layout_of(run_config(n).features, reg.FeatureAssets()) for n in RUN_FEATURES}
    assert {n: len(v.names) for n, v in widths.items()} == {"all-features": 898, "baseline-bert": 768, "baseline-fasttext": 300}


def test_embedding_only_model(spark):
    """A baseline run: no numerical block but the presence column's, every row predicted."""
    train, test, assets = flagship_inputs(spark, SF001)
    cfg = RunConfig(name="baseline", features=["DocumentEmbeddingsFastTextPool"], num_splits=2, num_trials=1, random_state=1)
    r = run(spark, train, test, cfg, assets)
    assert r.layout.numerical == [] and r.predictions.count() == test.count()
    assert r.cv.oof.count() == train.count()
