"""Fold table, resumable fold models, and a pipeline from text to prediction."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, FOLD, LABELS, TEXT
from glosa.functions import registry as reg
from glosa.operators import folds as fo
from glosa.operators.tuning import fit_model
from glosa.plans import pipeline as pl


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(140):
        x = rng.standard_normal(5)
        rows.append((i, f"text {'!' * (i % 5)} {'wort ' * (i % 9)}", *[int(x[t] + 0.4 * rng.standard_normal() > 0) for t in range(3)],
                     i % 7 if i < 126 else None, float(x[3]), [float(v) for v in x]))
    df = spark.createDataFrame(rows, f"{COMMENT_ID} long, {TEXT} string, " + ", ".join(f"{c} int" for c in LABELS)
                               + f", {FOLD} int, n double, e array<double>")
    path = str(tmp_path_factory.mktemp("folds") / "t")
    fo.write_folded(df, path)
    return fo.read_folded(spark, path, df), df, path


def test_folds_are_read_by_partition(spark, table):
    back, df, path = table
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.schema == df.schema
    for part, n in ((fo.valid_rows(back, 3), 18), (fo.train_rows(back, 3), 122), (back.where(F.col(FOLD).isNull()), 14)):
        assert part.count() == n
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    # A fold that is written again replaces its own rows only.
    copy = path + "-copy"
    fo.write_folded(df, copy)
    fo.write_folded(fo.valid_rows(df, 2).limit(1), copy)
    assert fo.read_folded(spark, copy, df).count() == 140 - 18 + 1


@pytest.fixture(scope="module")
def layout():
    return reg.FeatureLayout(["n"], [("e", 5)], ["n"] + [f"e{i}" for i in range(5)], ["numerical"] + ["embedding"] * 5)


def test_a_stopped_run_fits_only_the_folds_left(spark, table, layout, tmp_path, monkeypatch):
    feats, out = table[0], str(tmp_path / "models")
    cfg = pl.RunConfig(name="r", features=["NumWords"], num_splits=7, num_trials=4, random_state=1)
    real, fitted = pl.search_folds, []

    def stopping(data, layout, trials, folds, *a, **k):
        if len(fitted) == 3:
            raise RuntimeError("driver lost")
        fitted.extend(folds)
        return real(data, layout, trials, folds, *a, **k)
    monkeypatch.setattr(pl, "search_folds", stopping)
    with pytest.raises(RuntimeError, match="lost"):
        pl.cross_validate(spark, feats, layout, cfg, models_dir=out, folds_at_once=1)
    assert fitted == [0, 1, 2]
    again = []
    monkeypatch.setattr(pl, "search_folds", lambda d, la, tr, folds, *a, **k: again.extend(folds) or real(d, la, tr, folds, *a, **k))
    resumed = pl.cross_validate(spark, feats, layout, cfg, models_dir=out)
    assert again == [3, 4, 5, 6]
    whole = pl.cross_validate(spark, feats, layout, cfg)
    assert resumed.best == whole.best and sorted(map(str, resumed.trials.collect())) == sorted(map(str, whole.trials.collect()))
    cols = [COMMENT_ID, FOLD, *pl.PRED_COLS]
    assert sorted(map(tuple, resumed.oof.select(cols).collect())) == sorted(map(tuple, whole.oof.select(cols).collect()))
    # Another configuration takes nothing; a damaged copy raises.
    key = pl._fold_key(cfg, feats, layout)
    assert pl.load_fold(spark, f"{out}/fold=0", key, 0, layout) is not None
    assert pl.load_fold(spark, f"{out}/fold=0", key + "x", 0, layout) is None
    assert pl.load_fold(spark, f"{out}/fold=9", key, 9, layout) is None
    for f in (tmp_path / "models" / "fold=1" / "model" / "metadata").glob("*"):
        f.write_text("{}")
    for f in (tmp_path / "models" / "fold=1" / "model" / "metadata").glob(".*.crc"):
        f.write_text("")
    with pytest.raises(Exception):
        pl.cross_validate(spark, feats, layout, cfg, models_dir=out)


def test_text_in_prediction_out(spark, table, tmp_path):
    """Row-local features, scaling and regressions as one pipeline, saved and loaded."""
    names = ["NumWords", "NumCharacters", "ExclamationMarkRatio"]
    docs = table[0].where(F.col(FOLD).isNotNull()).select(COMMENT_ID, TEXT, *LABELS)
    stage = reg.TextFeatures(features=names)
    layout = reg.FeatureLayout([f"f_{n}" for n in names], [], names, ["numerical"] * 3)
    model = fit_model(stage.transform(docs), layout)
    path = str(tmp_path / "p")
    PipelineModel(stages=[stage, *model.pipeline().stages]).write().save(path)
    texts = docs.select(COMMENT_ID, TEXT).unionByName(spark.createDataFrame([(900, None), (901, "")], f"{COMMENT_ID} long, {TEXT} string"))
    out = PipelineModel.load(path).transform(texts)
    want = {r[0]: tuple(r[1:]) for r in model.predict(stage.transform(texts)).select(COMMENT_ID, "pred_0", "pred_1", "pred_2").collect()}
    got = {r[COMMENT_ID]: tuple(int(r[f"m_pred_{t}"]) for t in range(3)) for r in out.collect()}
    assert got == want and len(got) == 128
    feats, la = reg.build_features(docs, names)
    plain = {r[0]: tuple(r[1].toArray()) for r in reg.assemble(feats, la).select(COMMENT_ID, "num").collect()}
    assert {r[COMMENT_ID]: tuple(r.num.toArray()) for r in out.where(f"{COMMENT_ID} < 900").collect()} == plain
    with pytest.raises(ValueError, match="text alone"):
        reg.TextFeatures(features=["SentimentTextBlob"]).transform(docs)
