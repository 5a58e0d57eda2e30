"""Fold invariants, metric golden cases and vote semantics."""

import pytest
from pyspark.sql import functions as F

from glosa.columns import FOLD
from glosa.operators import ensemble as ens
from glosa.operators import evaluate as ev
from glosa.operators import folds as fo
from glosa.sources.comments import labelled

from conftest import SF01


@pytest.fixture(scope="module")
def folded(spark):
    return fo.assign_folds(labelled(spark, SF01), k=7, seed=42).cache()


def test_every_row_in_one_fold(folded, spark):
    base = labelled(spark, SF01)
    assert folded.count() == base.count()
    assert folded.select("comment_id").distinct().count() == base.count()
    assert folded.where(F.col(FOLD).isNull() | (F.col(FOLD) < 0) | (F.col(FOLD) > 6)).count() == 0


def test_class_spread_and_totals_within_one(folded):
    per = fo.fold_class_counts(folded).groupBy(fo.CODE).agg(
        (F.max("n_rows") - F.min("n_rows")).alias("spread"), F.count("*").alias("folds_used"), F.sum("n_rows"))
    for r in per.collect():
        assert r["spread"] <= 1
    totals = [r[1] for r in folded.groupBy(FOLD).count().collect()]
    assert max(totals) - min(totals) <= 1


def test_bucketing_does_not_change_folds(spark):
    df = labelled(spark, SF01)
    a = fo.assign_folds(df, bucket_digits=1).select("comment_id", F.col(FOLD).alias("a"))
    b = fo.assign_folds(df, bucket_digits=3).select("comment_id", F.col(FOLD).alias("b"))
    assert a.join(b, "comment_id").where("a != b").count() == 0


def test_seed_changes_membership(spark):
    df = labelled(spark, SF01)
    a = fo.assign_folds(df, seed=1).select("comment_id", F.col(FOLD).alias("a"))
    b = fo.assign_folds(df, seed=2).select("comment_id", F.col(FOLD).alias("b"))
    assert a.join(b, "comment_id").where("a != b").count() > 0


def test_null_fold_goes_to_train(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "comment_id long, fold int")
    tr, dev = fo.train_rows(df, 0), fo.valid_rows(df, 0)
    assert sorted(r[0] for r in tr.collect()) == [2, 3]
    assert [r[0] for r in dev.collect()] == [1]


def test_multiclass_codes_are_sorted_ranks(spark):
    df = spark.createDataFrame([(1, 1, 1, 0), (2, 0, 0, 0), (3, 0, 1, 0), (4, 0, 1, 0)],
                               "comment_id long, Sub1_Toxic int, Sub2_Engaging int, Sub3_FactClaiming int")
    got = {r["comment_id"]: (r["label_code"], r["class_id"])
           for r in fo.multilabel_to_multiclass(df).collect()}
    assert got == {1: ("[1 1 0]", 2), 2: ("[0 0 0]", 0), 3: ("[0 1 0]", 1), 4: ("[0 1 0]", 1)}


def test_metric_golden_case(spark):
    long = spark.createDataFrame([(0, "T", y, 0) for y in (1, 1, 0, 0)], "fold int, task string, label int, pred int")
    r = ev.task_metrics(long).first()
    assert r["precision"] == pytest.approx(0.25)
    assert r["recall"] == pytest.approx(0.5)
    assert r["f1"] == pytest.approx(1 / 3)
    assert r["accuracy"] == pytest.approx(0.5)


def test_metric_single_class_present(spark):
    long = spark.createDataFrame([(0, "T", 1, 1), (0, "T", 1, 1)], "fold int, task string, label int, pred int")
    r = ev.task_metrics(long).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (1.0, 1.0, 1.0, 1.0)


def test_macro_f1_objective(spark):
    rows = [(0, "A", 1, 1), (0, "A", 0, 1), (0, "B", 0, 0), (0, "B", 0, 0)]
    long = spark.createDataFrame(rows, "fold int, task string, label int, pred int")
    # task A: tp=1 fp=1 → F1 2/3; task B: no positives → 0
    assert ev.multilabel_macro_f1(long).first()["macro_f1"] == pytest.approx(1 / 3)


def test_vote_tie_is_positive_and_order_free(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 0, 0, 0), (2, 0, 0, 0, 1, 1, 1), (3, 0, 0, 0, 0, 1, 1)],
                               "id int, a int, b int, c int, d int, e int, f int")
    cols = [F.col(c) for c in "abcdef"]
    got = [r[1] for r in df.select("id", ens.vote(cols)).orderBy("id").collect()]
    assert got == [1, 1, 0]  # three of six is a tie → positive
    rev = [r[1] for r in df.select("id", ens.vote(cols[::-1])).orderBy("id").collect()]
    assert rev == got


def test_vote_long_matches_majority(spark):
    rows = [(i, t, m, (i * 7 + m * 3 + len(t)) % 2) for i in range(20) for t in ("A", "BB") for m in range(5)]
    long = spark.createDataFrame(rows, "comment_id int, task string, model int, pred int")
    for r in ens.vote_long(long).collect():
        votes = sum(p for (i, t, _, p) in rows if i == r[0] and t == r[1])
        assert r[2] == int(2 * votes >= 5)


def test_auto_bucket_digits_bounds_group_size():
    assert fo.auto_bucket_digits(0) == 1
    assert fo.auto_bucket_digits(10_000) == 1
    # A class of 30 billion rows (a third of 100 billion) still gets bounded groups.
    d = fo.auto_bucket_digits(30_000_000_000)
    assert d == fo.MAX_BUCKET_DIGITS
    assert fo.auto_bucket_digits(50_000_000) == 2 and 50_000_000 / 16 ** 2 <= fo.TARGET_GROUP_ROWS
    # Many classes: the broadcast start table stays under its cap.
    d = fo.auto_bucket_digits(30_000_000_000, n_classes=256)
    assert 256 * 16 ** d <= fo.MAX_START_ROWS
