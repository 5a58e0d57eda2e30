"""Hyper-parameter search over all folds (M5–M7).

Trials are drawn up front from a seeded generator — ``k`` uniform on
``[1, max(D−1, 1)]``, ``C`` log-uniform on ``[0.1, 1e4]``. The scaled unions of all
folds come from one scan (``operators.moments``); then all trials of all folds and
tasks are fitted together, a pass over the shared standardised block bringing the
gradients of all that are still open (``operators.paths``), and scored in one job.
The best trial's regressions are the refit (same data, same parameters, deterministic
solver).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.columns import FOLD, LABELS
from glosa.functions.registry import FeatureLayout
from glosa.operators.affine import LinearTaskModel
from glosa.operators.model import FoldModel, SharedStages, c_to_reg_param, raw_block, shared_stages
from glosa.operators.moments import fold_sums, scaled_union
from glosa.operators.paths import Block, Problems, solve
from glosa.session import right_size

C_LOW, C_HIGH = 0.1, 1e4
# Times the rarer class's share: how much of the optimality gap at zero a fit may leave (the reference's solver stops there too).
TOL = 0.1


@dataclass(frozen=True)
class Trial:
    idx: int
    k: int
    c: float


def search_space(num_trials: int, embedding_dim: int, seed: int) -> list[Trial]:
    """M5: seeded random search over ``(k, C)``."""
    rng = np.random.default_rng(seed)
    k_hi = max(embedding_dim - 1, 1)
    ks = rng.integers(1, k_hi + 1, size=num_trials)
    cs = np.exp(rng.uniform(math.log(C_LOW), math.log(C_HIGH), size=num_trials))
    return [Trial(i, int(k), float(c)) for i, (k, c) in enumerate(zip(ks, cs))]


def _score_trials(valid_x: DataFrame, shared: SharedStages, fitted: dict[int, list], trials: Sequence[Trial],
                  labels: Sequence[str]) -> dict[int, float]:
    """M6 for every trial in one job: positive-class F1 per task, mean over tasks.

    The coefficients of all trials and tasks, padded with zeros, are one matrix;
    each batch adds up its confusion counts."""
    width = shared.n_num + shared.k_max
    weights, intercepts = np.zeros((len(trials) * len(labels), width)), np.zeros(len(trials) * len(labels))
    for i, tr in enumerate(trials):
        for t, m in enumerate(fitted[tr.idx]):
            c = m.coefficients.toArray()
            weights[i * len(labels) + t, : len(c)] = c
            intercepts[i * len(labels) + t] = m.intercept
    names = list(labels)

    def counts(batches):
        for pdf in batches:
            if len(pdf):
                pred = (np.vstack(pdf["x"].to_numpy()) @ weights.T + intercepts > 0).reshape(len(pdf), -1, len(names))
                y = (pdf[names].to_numpy() == 1)[:, None, :]
                out = {n: v.sum(axis=0).ravel() for n, v in (("tp", y & pred), ("fp", ~y & pred), ("fn", y & ~pred))}
                yield pd.DataFrame({"item": np.arange(weights.shape[0]), **out})

    rows = valid_x.select(vector_to_array(shared.output).alias("x"), *names)
    conf = (rows.mapInPandas(counts, "item long, tp long, fp long, fn long").groupBy("item")
            .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect())
    f1 = np.zeros(weights.shape[0])
    for r in conf:
        f1[r["item"]] = 2 * r["tp"] / d if (d := 2 * r["tp"] + r["fp"] + r["fn"]) else 0.0
    return {tr.idx: float(v) for tr, v in zip(trials, f1.reshape(len(trials), -1).mean(axis=1))}


@dataclass
class FoldSearch:
    model: FoldModel
    scores: list[tuple[int, int, float, float]]  # (trial, k, C, score)
    best: Trial
    passes: int = 0  # over the data, for all folds and trials together


def standardised(raw: Column, centre: np.ndarray, scale: np.ndarray) -> Column:
    """(raw - centre) * scale of an ``array<double>`` column."""
    @F.pandas_udf("array<double>")
    def apply(rows: pd.Series) -> pd.Series:
        return pd.Series(list((np.vstack(rows.to_numpy()) - centre) * scale)) if len(rows) else pd.Series([], dtype=object)
    return apply(raw)


def _check_classes(data: DataFrame, folds: Sequence[int], labels: Sequence[str]) -> tuple[dict[int, int], dict[int, list[float]]]:
    """Rows of each fold, and the rarer class's share by task of each training fold.

    Q15: a task with one class in a training fold cannot be fitted."""
    sums = [F.sum(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in labels]
    found = {r[FOLD]: r for r in data.groupBy(FOLD).agg(F.count(F.lit(1)).alias("_n"), *sums).collect()}
    shares = {}
    for f in folds:
        n = sum(r["_n"] for k, r in found.items() if k != f)
        ones = [sum(r[c] for k, r in found.items() if k != f) for c in labels]
        single = [c for c, x in zip(labels, ones) if x == 0 or x == n]
        if single:
            raise ValueError(f"single class in the training fold for {single}; use fewer folds or more data")
        shares[f] = [min(x, n - x) / n for x in ones]
    return {k: r["_n"] for k, r in found.items()}, shares


def search_folds(data: DataFrame, layout: FeatureLayout, trials: Sequence[Trial], folds: Sequence[int],
                 labels: Sequence[str] = LABELS, prefix: str = "f{}_", pred_cols: Sequence[str] | None = None,
                 max_iter: int = 300, tol: float = TOL, waves: int = 1) -> dict[int, FoldSearch]:
    """Fit and score every trial on every fold, keep each fold's best (ties: first trial).

    ``data`` has the assembled blocks, the labels and ``fold`` (not null); a fold is
    fitted on the rows outside it and scored on its own, or on the others if it has none."""
    cols, raw, n_num, emb_dim = raw_block(layout)
    sizes, shares = _check_classes(data, folds, labels)
    total = sum(sizes.values())
    width = n_num + emb_dim
    sums = fold_sums(data, raw, F.col(FOLD))
    k_max = min(max(t.k for t in trials), emb_dim)
    spaces = {f: scaled_union(sums.training(f), n_num, k_max) for f in folds}
    every = sums.total()
    problems = [(f, t, n_num + min(tr.k, k_max), c_to_reg_param(tr.c, spaces[f].n), tol * shares[f][t]) for f in folds for tr in trials
                for t in range(len(labels))]
    p = Problems(*(np.array(v) for v in zip(*problems)))
    rows = data.select(F.col(FOLD).cast("int").alias("fold"), F.array(*[F.col(c).cast("double") for c in labels]).alias("y"),
                       standardised(raw, every.mean, every.scale()).alias("z"))
    rows = right_size(rows, total, 8 * (width + len(labels) + 4), work=4 * width * len(p)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        block = Block(rows, every.mean, every.scale(), spaces)
        solved = solve(block, p, n_num, max_iter=max_iter, waves=waves)
        f1 = block.f1(p, solved, np.array([not sizes.get(f) for f in p.fold.tolist()]))
    finally:
        rows.unpersist()
    scores = f1.reshape(len(folds), len(trials), len(labels)).mean(axis=2)
    out, names = {}, list(pred_cols or [f"pred_{t}" for t in range(len(labels))])
    for i, f in enumerate(folds):
        at = int(np.argmax(scores[i]))
        best, name = trials[at], prefix.format(f)
        shared = shared_stages(spaces[f], cols, name, n_num)
        first, wide = (i * len(trials) + at) * len(labels), n_num + min(best.k, k_max)
        regressions = [LinearTaskModel.of(f"{name}xk", f"{name}pred_{t}", solved.weights[first + t, :wide], solved.intercepts[first + t])
                       for t in range(len(labels))]
        table = [(tr.idx, tr.k, tr.c, float(v)) for tr, v in zip(trials, scores[i])]
        out[f] = FoldSearch(FoldModel(shared, best.k, best.c, regressions, names), table, best, solved.passes)
    return out


def tune_fold(train: DataFrame, valid: DataFrame | None, layout: FeatureLayout, trials: Sequence[Trial],
              labels: Sequence[str] = LABELS, prefix: str = "m_", pred_cols: Sequence[str] | None = None,
              max_iter: int = 300, tol: float = TOL, waves: int = 1) -> FoldSearch:
    """The search on one given split; without validation rows, scored on the training rows."""
    cols, _, _, _ = raw_block(layout)
    data = train.select(*cols, *labels, F.lit(1).alias(FOLD))
    if valid is not None:
        data = data.unionByName(valid.select(*cols, *labels, F.lit(0).alias(FOLD)))
    return search_folds(data, layout, trials, [0], labels, prefix, pred_cols, max_iter, tol, waves)[0]


def fit_model(train: DataFrame, layout: FeatureLayout, k: int | None = None, c: float = 1.0,
              labels: Sequence[str] = LABELS, prefix: str = "m_", max_iter: int = 300, tol: float = TOL) -> FoldModel:
    """M4 without a search: one fit with fixed parameters; ``k`` defaults to
    every embedding component and ``C`` to 1.0."""
    emb_dim = sum(d for _, d in layout.embeddings)
    trial = Trial(0, max(1, k if k is not None else emb_dim), c)
    return tune_fold(train, None, layout, [trial], labels, prefix=prefix, max_iter=max_iter, tol=tol).model
