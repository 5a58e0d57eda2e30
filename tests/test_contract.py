"""Driver contract, rows-only queries and the remaining source/sink/model contracts."""

import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glosa.columns import COMMENT_ID, FOLD, LABELS, TEXT
from glosa.functions.registry import FeatureAssets, FeatureLayout
from glosa.operators.model import FoldModel, fit_shared
from glosa.plans.pipeline import RunConfig, feature_table
from glosa.sources import comments as src
from glosa.sources import sinks

from conftest import SF001, SF01


def test_entry_runs_with_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == entry.entry(spark).columns
    rows = df.collect()
    assert len(rows) == 7 * 3  # folds × tasks


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows_only_query_runs(spark, name):
    df = entry.queries()[name](spark, SF001)
    assert df.count() > 0


def test_has_labels(spark):
    lab = src.labelled(spark, SF001)
    assert src.has_labels(lab)
    assert not src.has_labels(lab.drop(LABELS[1]))


def test_empty_feature_set_raises(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        fit_shared(df, FeatureLayout([], [], [], []), 1)


def test_predict_without_fit_raises(spark):
    m = FoldModel(shared=None, k=1, c=1.0, regressions=[], pred_cols=["p"])
    with pytest.raises(ValueError, match="before predicting"):
        m.predict(spark.createDataFrame([(1,)], "x int"))


def test_metrics_log_appends(spark):
    path = tempfile.mkdtemp(prefix="glosa-log-", dir="/tmp") + "/metrics"
    m = spark.createDataFrame([(0, "Toxic", 0.5)], "fold int, task string, f1 double")
    sinks.append_metrics(m, path, "a")
    sinks.append_metrics(m, path, "b")
    back = spark.read.parquet(path)
    assert back.count() == 2 and {r["run"] for r in back.collect()} == {"a", "b"}


def test_feature_store_keeps_inputs_apart(spark):
    """Two tables under one config name stay readable, and reuse never crosses inputs."""
    small, large = (src.comments(spark, d).withColumn(FOLD, F.lit(0)) for d in (SF001, SF01))
    cfg = RunConfig(name="cache", features=["NumWords", "NumCharacters"], num_trials=1)
    a, la = feature_table(spark, small, cfg, FeatureAssets(), cache_tag="t")
    b, _ = feature_table(spark, large, cfg, FeatureAssets(), cache_tag="t", reuse=True)
    again, lb = feature_table(spark, small, cfg, FeatureAssets(), cache_tag="t", reuse=True)
    assert (a.count(), b.count(), again.count()) == (small.count(), large.count(), small.count())
    assert la.numerical == lb.numerical and again.inputFiles() == a.inputFiles() != b.inputFiles()
    other, _ = feature_table(spark, small, cfg, FeatureAssets(stopwords=["x"]), cache_tag="t", reuse=True)
    assert other.inputFiles() != a.inputFiles()
    v1, _ = feature_table(spark, small.limit(5), cfg, FeatureAssets(), cache_tag="t", version="v1")
    v2, _ = feature_table(spark, small.limit(5), cfg, FeatureAssets(), cache_tag="t", version="v1", reuse=True)
    assert v1.inputFiles() == v2.inputFiles()


def test_model_store_keys_and_errors(spark, tmp_path):
    fits = []

    class Model:
        def __init__(self, n):
            self.n = n

        def write(self):
            return self

        def overwrite(self):
            return self

        def save(self, path):
            spark.createDataFrame([(self.n,)], "n int").write.mode("overwrite").parquet(path)

        @staticmethod
        def load(path):
            return Model(spark.read.parquet(path).first().n)

    def fit():
        fits.append(1)
        return Model(len(fits))
    got = [sinks.load_or_fit(spark, str(tmp_path / "m"), k, fit, Model).n for k in ("a", "a", "b", "b")]
    assert got == [1, 1, 2, 2]
    for f in (tmp_path / "m" / "model").iterdir():
        f.unlink()
    with pytest.raises(Exception, match="(?i)schema|parquet"):
        sinks.load_or_fit(spark, str(tmp_path / "m"), "b", fit, Model)
    assert len(fits) == 2


def test_csv_ingest_round_trip(spark):
    rows = [("7", "x\ny", 1, 0, 0), ("8", "", 0, 0, 1)]
    df = spark.createDataFrame(rows, src.TRAIN_SCHEMA)
    path = src.write_comments_csv(df)
    out = tempfile.mkdtemp(prefix="glosa-ingest-", dir="/tmp") + "/p"
    src.ingest_csv(src.read_comments_csv(spark, path), out, partitions=2)
    back = {r[COMMENT_ID]: r[TEXT] for r in spark.read.parquet(out).collect()}
    assert back == {"7": "x\ny", "8": None}  # an empty field reads back as null


def test_prefolded_csv_split(spark):
    """A ``;``-separated corpus with a fold column; a null fold trains in every split."""
    from glosa.operators import folds as fo
    rows = [("1", "a; b", 1, 0, 0, 0), ("2", "c", 0, 1, 0, 1), ("3", "d", 0, 0, 1, None)]
    df = spark.createDataFrame(rows, src.FOLDED_SCHEMA)
    path = src.write_comments_csv(df, sep=";")
    back = src.read_folded_csv(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    train, dev = fo.split_fold(back, 0)
    assert FOLD not in train.columns and COMMENT_ID not in dev.columns
    assert sorted(r[TEXT] for r in train.collect()) == ["c", "d"]
    assert [r[TEXT] for r in dev.collect()] == ["a; b"]
