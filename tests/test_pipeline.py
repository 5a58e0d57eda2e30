"""A small end-to-end run plus the sources and sinks around it."""

import tempfile

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, LABELS, TEXT
from glosa.plans.flagship import flagship_inputs
from glosa.plans.pipeline import RunConfig, read_config, run
from glosa.sources import comments as src
from glosa.sources import sinks

from conftest import SF001

FEATURES = ["DocumentEmbeddingsFastTextPool", "SentimentTextBlob", "SpellingMistakes", "NumWords",
            "NumCharacters", "StopwordRatio", "ExclamationMarkRatio", "NumReferences", "NumUserAdressed"]


@pytest.fixture(scope="module")
def result(spark):
    train, test, assets = flagship_inputs(spark, SF001)
    cfg = RunConfig(name="test-run", features=FEATURES, num_splits=3, num_trials=2, random_state=1)
    return run(spark, train, test, cfg, assets), train, test


def test_out_of_fold_covers_train(result):
    r, train, _ = result
    assert r.cv.oof.count() == train.count()
    assert r.cv.oof.select(COMMENT_ID).distinct().count() == train.count()
    assert r.cv.metrics.count() == 9
    assert r.cv.summary.count() == 3
    assert r.cv.trials.count() == 3 * 2


def test_predictions_cover_test(result):
    r, _, test = result
    p = r.predictions
    assert p.count() == test.count()
    assert p.where(" OR ".join(f"{c} NOT IN (0, 1)" for c in LABELS)).count() == 0


def test_importance_top_k(result):
    imp = result[0].cv.importance
    assert imp.groupBy("fold", "task").count().where("count > 25").count() == 0


def test_model_store_round_trip(result, spark):
    r, train, _ = result
    m = r.cv.models[0]
    path = tempfile.mkdtemp(prefix="glosa-model-", dir="/tmp") + "/fold0"
    sinks.save_model(m.pipeline(), path)
    loaded = PipelineModel.load(path)
    assert len(loaded.stages) == len(m.pipeline().stages)


def test_submission_csv_round_trip(spark):
    rows = [("1", 'a "quoted"\nline', 1, 0, 1), ("2", "back\\slash, comma", 0, 1, 0)]
    df = spark.createDataFrame(rows, src.TRAIN_SCHEMA)
    out = tempfile.mkdtemp(prefix="glosa-sub-", dir="/tmp")
    sinks.write_submission(df, out)
    back = src.read_comments_csv(spark, f"{out}/submission_with_text", labelled=True)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    plain = spark.read.option("header", True).csv(f"{out}/submission")
    assert TEXT not in plain.columns and plain.count() == 2


def test_read_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("name: x\nnum_splits: 7\nnum_trials: 3\nfeatures: [NumWords, NumCharacters]\nrandom_state: 42\n")
    cfg = read_config(str(p))
    assert cfg.features == ["NumWords", "NumCharacters"] and cfg.num_trials == 3
    p.write_text("name: x\nnum_splits: 7\nnum_trials: 3\nfeatures: [Nope]\nrandom_state: 42\n")
    with pytest.raises(KeyError):
        read_config(str(p))


def test_stream_scoring_matches_batch(result, spark):
    """Test comments arriving as files get the batch ensemble's predictions; a
    replayed batch overwrites its own partition (no duplicates)."""
    from glosa.streaming.scoring import comment_stream, start_scoring
    r, _, test = result
    _, _, assets = flagship_inputs(spark, SF001)
    src_dir = tempfile.mkdtemp(prefix="glosa-stream-in-", dir="/tmp")
    out_dir = tempfile.mkdtemp(prefix="glosa-stream-out-", dir="/tmp") + "/preds"
    rows = test.select(F.col(COMMENT_ID).cast("string").alias(COMMENT_ID), TEXT)
    rows.where(F.col(COMMENT_ID).cast("long") % 2 == 0).write.parquet(f"{src_dir}/a")
    rows.where(F.col(COMMENT_ID).cast("long") % 2 == 1).write.parquet(f"{src_dir}/b")
    stream = comment_stream(spark, f"{src_dir}/*", max_files_per_trigger=1)
    q = start_scoring(stream, FEATURES, assets, r.layout, r.cv.models, out_dir, available_now=True)
    q.awaitTermination(600)
    got = spark.read.parquet(out_dir)
    assert got.select("batch_id").distinct().count() >= 2
    want = r.predictions.select(F.col(COMMENT_ID).cast("string").alias(COMMENT_ID), *LABELS)
    assert got.count() == want.count()
    assert got.select(COMMENT_ID, *LABELS).exceptAll(want).count() == 0
