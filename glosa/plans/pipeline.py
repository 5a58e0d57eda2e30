"""End-to-end run (E1, M11, S4, S8): features → folds → search per fold →
out-of-fold metrics → fold-ensemble vote on the test rows.

The driver loops over folds and trials and holds only metadata (trial
parameters, coefficients, scores, metric rows); all data stays in Spark. The
feature table is written once to the shared checkpoint folder under a key
derived from the feature list, and every fold reads that copy — lineage is
cut there, so a lost executor recomputes from Parquet, not from the texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import yaml
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, FOLD, LABELS, TASKS, TEXT
from glosa.functions.registry import (FeatureAssets, FeatureLayout, assemble, asset_tables, build_features,
                                      feature_set_hash, incomplete_rows, resolve)
from glosa.operators import ensemble as ens
from glosa.operators import evaluate as ev
from glosa.operators import folds as fo
from glosa.operators.model import FoldModel, SharedStages, feature_importance, positive_margins
from glosa.operators.tuning import FoldSearch, Trial, search_folds, search_space
from glosa.session import copies_dropped, cut_lineage, path_exists, shared_dir, shuffles_dropped
from glosa.sources import sinks


@dataclass
class RunConfig:
    """The reference's run config."""
    name: str
    features: list[str]
    num_splits: int = 7
    num_trials: int = 100
    random_state: int = 42

    def __post_init__(self):
        resolve(self.features)  # unknown names raise here (Q8)
        if self.num_splits < 2:
            raise ValueError("num_splits must be at least 2")
        if self.num_trials < 1:
            raise ValueError("num_trials must be at least 1 (the best trial's parameters are refitted)")


def read_config(path: str, **overrides) -> RunConfig:
    with open(path) as fh:
        raw = yaml.safe_load(fh)
    raw.update(overrides)
    return RunConfig(name=raw["name"], features=list(raw["features"]), num_splits=int(raw["num_splits"]),
                     num_trials=int(raw["num_trials"]), random_state=int(raw["random_state"]))


def fingerprint(df: DataFrame) -> str:
    """Of a frame's input files and plan, without reading rows: their paths, and
    the optimized plan without expression ids. Frames without files get a new
    one each time, so nothing stored is taken for them."""
    files = sorted(df.inputFiles())
    if not files:
        return uuid.uuid4().hex
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    stats = []
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(f)
        st = path.getFileSystem(conf).getFileStatus(path)
        stats.append((f, st.getLen(), st.getModificationTime()))
    plan = re.sub(r"#\d+L?|plan_id=\d+", "", df._jdf.queryExecution().optimizedPlan().toString())
    return hashlib.sha1(json.dumps([stats, plan]).encode()).hexdigest()


def feature_table(spark: SparkSession, comments: DataFrame, cfg: RunConfig, assets: FeatureAssets,
                  cache_tag: str | None = None, reuse: bool = False, fit_rows: DataFrame | None = None,
                  version: str | None = None) -> tuple[DataFrame, FeatureLayout]:
    """Features computed once, stored in a new folder of the shared one and read back.

    ``reuse`` takes an earlier copy whose manifest has the same key: feature
    list, parameters, and the fingerprints of the comments and of the asset
    tables, or the caller's ``version`` in their place."""
    if cache_tag is None:
        return build_features(comments, cfg.features, assets, fit_rows=fit_rows)
    df = layout = None
    if reuse:
        df, layout = build_features(comments, cfg.features, assets, fit_rows=fit_rows)
    tables = {"comments": comments, **asset_tables(assets)}
    inputs = {"version": version} if version is not None else {n: fingerprint(t) for n, t in tables.items()}
    key = feature_set_hash(cfg.features, assets, inputs)
    base = f"{shared_dir(spark)}/features-{cache_tag}"
    manifest = f"{base}/manifest"
    if reuse and path_exists(spark, manifest):
        known = spark.read.parquet(manifest).where(F.col("key") == key).orderBy(F.desc("stored")).first()
        if known is not None:
            return _read_features(spark, known["path"], df), layout
    # Folds are ranked once, not once for each feature that reads the rows. Copies made for the
    # features go when those are stored.
    with copies_dropped(spark):
        df, layout = build_features(cut_lineage(comments), cfg.features, assets, fit_rows=fit_rows)
        key = feature_set_hash(cfg.features, assets, inputs)
        path = f"{base}/{uuid.uuid4().hex}"
        with shuffles_dropped(spark):
            if FOLD in df.columns:
                fo.write_folded(df, path)  # S2: folds and test rows are read by partition
            else:
                df.write.parquet(path)
    # The entry is added when the copy is whole.
    (spark.createDataFrame([(key, path)], "key string, path string").withColumn("stored", F.current_timestamp())
     .coalesce(1).write.mode("append").parquet(manifest))
    return _read_features(spark, path, df), layout


def _read_features(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return fo.read_folded(spark, path, like) if FOLD in like.columns else spark.read.parquet(path)


@dataclass
class CVResult:
    models: dict[int, FoldModel]
    trials: DataFrame
    oof: DataFrame  # id, fold, labels, pred_0..2
    metrics: DataFrame  # A1 per fold × task
    summary: DataFrame  # A2
    importance: DataFrame  # M9
    incomplete_rows: int = 0  # labelled rows with a missing feature, filled in; none is left out
    best: dict[int, tuple[int, float]] = field(default_factory=dict)


PRED_COLS = [f"pred_{i}" for i in range(len(LABELS))]


def _fold_key(cfg: RunConfig, feats: DataFrame, layout: FeatureLayout) -> str:
    """Of a run's models: configuration, layout and the feature table's files."""
    parts = [cfg.features, cfg.num_splits, cfg.num_trials, cfg.random_state, layout.names, fingerprint(feats)]
    return hashlib.sha1(json.dumps(parts).encode()).hexdigest()


def save_fold(spark: SparkSession, folder: str, key: str, search: FoldSearch) -> None:
    """A fold's pipeline and trials, then the manifest that makes them count."""
    sinks.save_model(search.model.pipeline(), f"{folder}/model")
    trials = spark.createDataFrame(search.scores, "trial int, k int, c double, score double")
    trials.coalesce(1).write.mode("overwrite").parquet(f"{folder}/trials")
    spark.createDataFrame([(key, search.best.idx)], "key string, best int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def load_fold(spark: SparkSession, folder: str, key: str, fold: int, layout: FeatureLayout) -> FoldSearch | None:
    """A fold saved under this key, or None. A damaged copy raises."""
    if not path_exists(spark, f"{folder}/manifest"):
        return None
    known = spark.read.parquet(f"{folder}/manifest").where(F.col("key") == key).first()
    if known is None:
        return None
    shared, slicer, *regressions = PipelineModel.load(f"{folder}/model").stages
    scores = [tuple(r) for r in spark.read.parquet(f"{folder}/trials").orderBy("trial").collect()]
    best = next(Trial(i, k, c) for i, k, c, _ in scores if i == known["best"])
    n_num = len(layout.numerical)
    stages = SharedStages(PipelineModel(stages=[shared]), f"f{fold}_", n_num, len(shared.numbers()[1]) - n_num)
    return FoldSearch(FoldModel(stages, len(slicer.getIndices()) - n_num, best.c, regressions, PRED_COLS), scores, best)


def cross_validate(spark: SparkSession, feats: DataFrame, layout: FeatureLayout, cfg: RunConfig,
                   top_k: int = 25, max_iter: int = 300, models_dir: str | None = None,
                   folds_at_once: int | None = None) -> CVResult:
    """Search the folds together → keep each fold's best → predict its rows.

    With ``models_dir`` (S5), folds saved there for the same configuration and feature
    table are loaded, and only the others searched, ``folds_at_once`` (None: all) before
    they are saved: what a lost driver has finished is not fitted again."""
    labelled = feats.where(F.col(FOLD).isNotNull())
    data = assemble(labelled, layout)
    emb_dim = sum(d for _, d in layout.embeddings)
    trials = search_space(cfg.num_trials, emb_dim, cfg.random_state)
    searches, key = {}, _fold_key(cfg, feats, layout) if models_dir else ""
    for k in range(cfg.num_splits if models_dir else 0):
        if (found := load_fold(spark, f"{models_dir}/fold={k}", key, k, layout)) is not None:
            searches[k] = found
    todo = [k for k in range(cfg.num_splits) if k not in searches]
    step = max(1, folds_at_once or len(todo) or 1)
    for i in range(0, len(todo), step):
        new = search_folds(data, layout, trials, todo[i: i + step], LABELS, pred_cols=PRED_COLS, max_iter=max_iter)
        for k, s in new.items():
            if models_dir:
                save_fold(spark, f"{models_dir}/fold={k}", key, s)
            searches[k] = s
    searches = dict(sorted(searches.items()))
    models = {k: s.model for k, s in searches.items()}
    trial_rows = [(k, *row) for k, s in searches.items() for row in s.scores]
    trials_df = spark.createDataFrame(trial_rows, "fold int, trial int, k int, c double, macro_f1 double")
    # One projection scores every fold's model; a row takes its own fold's predictions.
    scored = _affine_predictions(data.select(COMMENT_ID, FOLD, *LABELS, *_model_inputs(layout)), layout, models)
    own = [F.coalesce(*[F.when(F.col(FOLD) == k, F.col(f"vote_f{k}_{t}")) for k in sorted(models)]).alias(c)
           for t, c in enumerate(PRED_COLS)]
    oof = scored.select(COMMENT_ID, FOLD, *LABELS, *own)
    metrics = ev.task_metrics(ev.to_long(oof, PRED_COLS))
    return CVResult(models=models, trials=trials_df, oof=oof, metrics=metrics,
                    summary=ev.metrics_summary(metrics),
                    importance=feature_importance(spark, models, layout, top_k),
                    incomplete_rows=incomplete_rows(labelled, layout),
                    best={k: (s.best.k, s.best.c) for k, s in searches.items()})


def _affine_predictions(rows: DataFrame, layout: FeatureLayout, models: dict[int, FoldModel]) -> DataFrame:
    """All fold × task predictions as ``vote_f{fold}_{task}``: one matrix on the raw blocks."""
    named = [(f"vote_f{k}_{t}", w, b) for k, m in sorted(models.items()) for t, (w, b) in enumerate(m.affine())]
    margins = positive_margins(np.vstack([w for _, w, _ in named]), np.array([b for _, _, b in named]))
    raw = F.concat(*[vector_to_array(c) for c in _model_inputs(layout)])
    votes = rows.withColumn("_votes", margins(raw))
    return votes.select(*rows.columns, *[F.col("_votes")[i].alias(n) for i, (n, _, _) in enumerate(named)])


def _model_inputs(layout: FeatureLayout) -> list[str]:
    return (["num"] if layout.numerical else []) + (["emb"] if layout.embeddings else [])


def predict_ensemble(test_feats: DataFrame, layout: FeatureLayout, models: dict[int, FoldModel],
                     keep: Sequence[str] = (COMMENT_ID,)) -> DataFrame:
    """M10 with the fold models in one plan: each adds its prediction columns to
    the same rows, then an in-row vote — no shuffle."""
    cur = assemble(test_feats, layout).select(*keep, *_model_inputs(layout))
    cur = _affine_predictions(cur, layout, models)
    return cur.select(*keep, *[ens.vote([F.col(f"vote_f{k}_{t}") for k in sorted(models)]).alias(lab)
                               for t, lab in enumerate(LABELS)])


@dataclass
class RunResult:
    cv: CVResult
    predictions: DataFrame  # comment_id + three 0/1 columns
    layout: FeatureLayout
    unlabelled_rows: int = 0  # training rows with a null label: in no fold and no fit


def write_outputs(result: RunResult, test: DataFrame, out_dir: str, name: str) -> None:
    """The run's files: both submissions, metric log, summary, importances and fold models."""
    sinks.write_submission(sinks.attach_predictions(test, result.predictions), f"{out_dir}/submissions")
    sinks.append_metrics(result.cv.metrics, f"{out_dir}/metrics", name)
    result.cv.summary.write.mode("overwrite").parquet(f"{out_dir}/summary")
    result.cv.importance.write.mode("overwrite").parquet(f"{out_dir}/importance")
    for k, m in result.cv.models.items():
        sinks.save_model(m.pipeline(), f"{out_dir}/models/fold={k}")


def run(spark: SparkSession, train: DataFrame, test: DataFrame, cfg: RunConfig, assets: FeatureAssets,
        top_k: int = 25, cache_tag: str | None = None, max_iter: int = 300,
        bucket_digits: int | None = None, out_dir: str | None = None, models_dir: str | None = None,
        folds_at_once: int | None = None, version: str | None = None) -> RunResult:
    """``train`` has ``comment_id, c_text`` and the three labels; ``test``
    has ``comment_id, c_text``. Every test row gets a prediction, every row
    with labels a fold. ``out_dir`` takes the run's files. ``models_dir`` makes the run
    resumable: stored features of the same inputs (or ``version``) and fold models saved
    there are taken."""
    folded = fo.assign_folds(train, k=cfg.num_splits, seed=cfg.random_state, bucket_digits=bucket_digits)
    test_rows = test.select(COMMENT_ID, TEXT, *[F.lit(None).cast("int").alias(c) for c in LABELS],
                            F.lit(None).cast("int").alias(FOLD))
    unlabelled = folded.where(F.col(FOLD).isNull()).count()
    folded = folded.where(F.col(FOLD).isNotNull())
    rows = folded.select(COMMENT_ID, TEXT, *LABELS, FOLD).unionByName(test_rows)
    feats, layout = feature_table(spark, rows, cfg, assets, cache_tag or cfg.name,
                                  reuse=models_dir is not None, version=version,
                                  fit_rows=folded.select(TEXT))  # trainable features see the training text
    cv = cross_validate(spark, feats, layout, cfg, top_k=top_k, max_iter=max_iter, models_dir=models_dir,
                        folds_at_once=folds_at_once)
    test_feats = feats.where(F.col(FOLD).isNull())
    result = RunResult(cv, predict_ensemble(test_feats, layout, cv.models), layout, unlabelled)
    if out_dir is not None:
        write_outputs(result, test, out_dir, cfg.name)
    return result


__all__ = ["RunConfig", "read_config", "run", "cross_validate", "predict_ensemble", "feature_table", "TASKS"]
