"""Many L1 logistic regressions in one pass over the data (M3, M5).

A problem is one (fold, task, width, penalty): the mean logistic loss over the rows
outside the fold plus λ‖w‖₁ on the first ``width`` columns of the fold's scaled union;
the intercept is free. All problems share one standardised block of rows. Each pass
sends it the weights of the problems still open, mapped from each fold's space to the
block, and brings back all their gradients: one product for the margins, one for the
gradients, whatever the number of trials.

Between passes the driver takes a proximal step for each problem. A logistic loss
curves at most a quarter as much as half the squares of its rows, whose covariances
are known from the fold moments, so the step minimises an upper bound of the objective
and needs no line search; coordinate descent finds it (numerical columns one by one,
components, which are uncorrelated, at once). Steps are accelerated and restarted when
they turn back (FISTA with adaptive restart).

Problems of a fold and task may run along their penalties in ``waves``, from the
strongest on: a wave starts where the nearest stronger penalty ended. Each wave costs
passes of its own, and one for all has taken a third of the passes of four.

A problem ends when what its last step leaves of the optimality conditions, summed over
coefficients, is at most its ``tol`` of what they miss by at zero; or after ``max_iter`` passes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glosa.operators.moments import Space, batch_matrix, count_parts, summed_rows

CURVE = 0.25
ROWS = 2048  # of a batch at a time: their margins for all problems are held


@dataclass
class Problems:
    fold: np.ndarray
    task: np.ndarray
    width: np.ndarray
    penalty: np.ndarray
    tol: np.ndarray

    def __len__(self) -> int:
        return len(self.fold)

    def take(self, at: np.ndarray) -> Problems:
        return Problems(*(v[at] for v in (self.fold, self.task, self.width, self.penalty, self.tol)))


@dataclass
class Solutions:
    weights: np.ndarray  # problem × column of the fold's scaled union
    intercepts: np.ndarray
    passes: int
    open: int  # problems that max_iter ended


def _residuals(z: np.ndarray, y: np.ndarray, weights: np.ndarray, intercepts: np.ndarray, tasks: np.ndarray) -> np.ndarray:
    margins = z @ weights + intercepts
    np.clip(margins, -500, 500, out=margins)
    return 1.0 / (1.0 + np.exp(-margins)) - y[:, tasks]


def _gradients(held):
    """Sums of the gradients of all problems over the rows outside their folds, the intercepts' last."""
    def run(batches):
        weights, intercepts, folds, tasks = held.value
        d = len(weights)
        acc = np.zeros((d + 1, len(folds)))
        for batch in batches:
            every, labels, own = batch_matrix(batch.column("z")), batch_matrix(batch.column("y")), batch.column("fold").to_numpy()
            for a in range(0, batch.num_rows, ROWS):
                z = every[a: a + ROWS]
                r = _residuals(z, labels[a: a + ROWS], weights, intercepts, tasks)
                r[own[a: a + ROWS, None] == folds] = 0.0
                acc[:d] += z.T @ r
                acc[d] += r.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array([*acc], pa.list_(pa.float64()))],
                                         names=["i", "row"])
    return run


def _confusions(held):
    """True positives, false positives and false negatives of all problems on their folds' rows (on all, where ``anywhere``)."""
    def run(batches):
        weights, intercepts, folds, tasks, anywhere = held.value
        acc = np.zeros((3, len(folds)))
        for batch in batches:
            every, labels, own = batch_matrix(batch.column("z")), batch_matrix(batch.column("y")), batch.column("fold").to_numpy()
            for a in range(0, batch.num_rows, ROWS):
                said = every[a: a + ROWS] @ weights + intercepts > 0
                y = labels[a: a + ROWS][:, tasks] > 0.5
                here = (own[a: a + ROWS, None] == folds) | anywhere
                for k, c in enumerate((y & said, ~y & said, y & ~said)):
                    acc[k] += (c & here).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(3, dtype=np.int32)), pa.array([*acc], pa.list_(pa.float64()))],
                                         names=["i", "row"])
    return run


class Block:
    """The shared standardised rows: ``z`` (array<double>), ``y`` (array<double> of 0/1, one a task) and ``fold`` (int).

    z = (raw - centre) * scale; ``spaces`` has each fold's scaled union of the raw rows."""

    def __init__(self, rows: DataFrame, centre: np.ndarray, scale: np.ndarray, spaces: dict[int, Space]):
        self.rows, self.spaces = rows, spaces
        self.parts = count_parts(rows)
        self.maps = {f: (s.matrix / scale, s.shift + s.matrix @ centre) for f, s in spaces.items()}

    def _sent(self, p: Problems, weights: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercepts on ``z``."""
        d = next(iter(self.maps.values()))[0].shape[1]
        v, c = np.empty((d, len(p))), np.empty(len(p))
        for f, (matrix, shift) in self.maps.items():
            at = np.flatnonzero(p.fold == f)
            v[:, at] = matrix.T @ weights[at].T
            c[at] = intercepts[at] + weights[at] @ shift
        return v, c

    def _summed(self, run, sent: tuple, height: int) -> np.ndarray:
        held = self.rows.sparkSession.sparkContext.broadcast(sent)
        parts = self.rows.select("fold", "y", "z").mapInArrow(run(held), "i int, row array<double>")
        out = np.zeros((height, len(sent[2])))
        for i, row in summed_rows(parts, ["i"], self.parts, 8 * height * len(sent[2])):
            out[i] = row
        held.destroy()
        return out

    def gradients(self, p: Problems, weights: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean gradients in each problem's own space, and those of the intercepts."""
        v, c = self._sent(p, weights, intercepts)
        sums = self._summed(_gradients, (v, c, p.fold, p.task), len(v) + 1)
        out = np.empty((len(p), next(iter(self.maps.values()))[0].shape[0]))
        n = np.array([self.spaces[f].n for f in p.fold], float)
        for f, (matrix, shift) in self.maps.items():
            at = np.flatnonzero(p.fold == f)
            out[at] = (matrix @ sums[:-1, at] + np.outer(shift, sums[-1, at])).T
        return out / n[:, None], sums[-1] / n

    def f1(self, p: Problems, s: Solutions, anywhere: np.ndarray) -> np.ndarray:
        """Positive-class F1 of each problem on its fold."""
        v, c = self._sent(p, s.weights, s.intercepts)
        tp, fp, fn = self._summed(_confusions, (v, c, p.fold, p.task, anywhere), 3)
        d = 2 * tp + fp + fn
        return np.where(d > 0, 2 * tp / np.where(d > 0, d, 1.0), 0.0)


def _soft(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0.0)


def proximal_step(gram: np.ndarray, n_num: int, y: np.ndarray, g: np.ndarray, penalty: np.ndarray, width: np.ndarray,
                  sweeps: int = 20, tol: float = 0.01) -> np.ndarray:
    """argmin over u of g·(u-y) + CURVE/2 (u-y)ᵀ gram (u-y) + penalty |u|₁, columns of ``y`` and ``g`` being problems.

    Sweeps end when the last one moved each problem by ``tol`` of its whole step at most:
    steps shrink as a problem converges, and with them what a step is off by."""
    d = len(gram)
    a = CURVE * np.diag(gram)
    used = a > 0.5 * CURVE  # scaled columns have variance 1, those without any 0
    inside = np.arange(d)[:, None] < width
    u = np.where(inside & used[:, None], y, 0.0)
    free = [j for j in range(n_num) if used[j]]
    tail = np.arange(n_num, d)[used[n_num:]]
    cross = CURVE * gram[np.ix_(tail, np.arange(n_num))] if len(tail) else None
    for _ in range(sweeps):
        before, move = u.copy(), u - y
        for j in free:
            q = g[j] + CURVE * (gram[j] @ move)
            u[j] = np.where(inside[j], _soft(u[j] - q / a[j], penalty / a[j]), 0.0)
            move[j] = u[j] - y[j]
        if len(tail):
            q = g[tail] + cross @ move[:n_num]  # components are uncorrelated: each has its own minimum at once
            u[tail] = np.where(inside[tail], _soft(y[tail] - q / CURVE, penalty / CURVE), 0.0)
        if not free or (np.abs(u - before).max(axis=0) <= tol * np.abs(u - y).max(axis=0)).all():
            break
    return u


def _run(block: Block, p: Problems, n_num: int, weights: np.ndarray, intercepts: np.ndarray, zero: dict,
         max_iter: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    w, b = weights.copy(), intercepts.copy()
    y, c, t = w.copy(), b.copy(), np.ones(len(p))
    todo, passes, missed = np.arange(len(p)), 0, None
    while len(todo) and passes < max_iter:
        some = p.take(todo)
        g, g0 = block.gradients(some, y[todo], c[todo])
        passes += 1
        for k, i in enumerate(todo):
            if not w[i].any() and not b[i] and passes == 1:
                zero.setdefault((p.fold[i], p.task[i]), (g[k], g0[k]))
        if missed is None:
            missed = np.array([_missed(zero[f, k], lam, wide) for f, k, lam, wide in zip(p.fold, p.task, p.penalty, p.width)])
        new, gap = np.empty_like(g), np.empty(len(todo))
        for f, space in block.spaces.items():
            at = np.flatnonzero(some.fold == f)
            if len(at):
                old = y[todo[at]].T
                u = proximal_step(space.gram, n_num, old, g[at].T, some.penalty[at], some.width[at])
                new[at] = u.T
                gap[at] = CURVE * np.abs(space.gram @ (u - old)).sum(axis=0)
        b_new = c[todo] - g0 / CURVE
        gap += np.abs(g0)
        back = ((y[todo] - new) * (new - w[todo])).sum(axis=1) + (c[todo] - b_new) * (b_new - b[todo]) > 0
        now = np.where(back, 1.0, t[todo])
        after = (1 + np.sqrt(1 + 4 * now * now)) / 2
        push = (now - 1) / after
        y[todo] = new + push[:, None] * (new - w[todo])
        c[todo] = b_new + push * (b_new - b[todo])
        w[todo], b[todo], t[todo] = new, b_new, after
        todo = todo[gap > p.tol[todo] * missed[todo]]
    return w, b, passes, len(todo)


def _missed(zero: tuple[np.ndarray, float], penalty: float, width: int) -> float:
    """How far zero is from optimal."""
    return float(np.maximum(np.abs(zero[0][:width]) - penalty, 0.0).sum() + abs(zero[1]))


def solve(block: Block, p: Problems, n_num: int, *, max_iter: int = 300, waves: int = 1) -> Solutions:
    """Solutions of all problems, in waves of falling penalty."""
    d = next(iter(block.maps.values()))[0].shape[0]
    weights, intercepts = np.zeros((len(p), d)), np.zeros(len(p))
    groups: dict[tuple, np.ndarray] = {}
    for f, k in sorted({*zip(p.fold.tolist(), p.task.tolist())}):
        at = np.flatnonzero((p.fold == f) & (p.task == k))
        groups[f, k] = at[np.argsort(-p.penalty[at], kind="stable")]
    waves = max(1, min(waves, max((len(v) for v in groups.values()), default=1)))
    zero, passes, left = {}, 0, 0
    for wave in range(waves):
        todo = []
        for at in groups.values():
            cuts = np.linspace(0, len(at), waves + 1).astype(int)
            for k in range(cuts[wave], cuts[wave + 1]):
                todo.append(at[k])
                if cuts[wave]:
                    start = at[cuts[wave] - 1]  # the nearest stronger penalty that has ended
                    weights[at[k], : p.width[at[k]]] = weights[start, : p.width[at[k]]]
                    intercepts[at[k]] = intercepts[start]
        todo = np.array(todo, int)
        if len(todo):
            weights[todo], intercepts[todo], n, some = _run(block, p.take(todo), n_num, weights[todo], intercepts[todo], zero, max_iter)
            passes, left = passes + n, left + some
    return Solutions(weights, intercepts, passes, left)
