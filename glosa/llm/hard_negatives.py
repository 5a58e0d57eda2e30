"""Operator 12: hard negatives of embeddings by Fagin's threshold algorithm.

Vectors become whole numbers, floor(scale * x) of each component, and a row's score
for an anchor is their inner product; higher scores come first, ties by smaller id.
An anchor's positives are its first rows of the same label. Each positive opens a
window of scores, from ``low`` to ``high`` percent of its own, and the first rows of
other labels within are its negatives.

The rows are searched where they lie, in blocks. A block keeps a list of its rows for
each dimension, sorted by that component. For an anchor the lists are read in step,
from the top where its component is positive and from the bottom where it is negative
(a zero needs no list). A row met for the first time in any list is looked up whole
and scored. No row that was not met can score more than the threshold, the sum over
the lists of the anchor's component times the one read last. Reading stops once the
threshold is strictly below the last score that still counts: the k-th of each window
(of the label's rows, for positives), or the window's lower end while it has fewer.
Strictly, as a tie may have a smaller id. What earlier blocks of the task have found
counts, so that later ones often stop before the first row. The depths double twice
at each look, so that numpy works on slices.

Anchors are sent to all tasks in groups of bounded bytes. A task returns at most k rows
for an anchor or window, whatever it reads, and those are ranked by a window function
that cuts to k before the shuffle. Two passes: positives first, then windows.

Rows with a null id, label or vector, or with a null or non-finite component, take no
part. A shorter vector counts as filled up with zeros. Scores are exact: in doubles while
all sums stay below 2^53, in Python's integers otherwise; one beyond a long is given
as the nearest long. Repeated rows are rows of their own: equal ones are each other's
positives, and a repeated anchor has its rows twice. An anchor without positives, or
a positive without rows in its window (as any of a negative score), has no rows. An
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosa.llm.common import stored

BLOCK_VALUES = 1 << 18  # components in a block: 4,096 rows of 64
GROUP_BYTES = 16_000_000
EXACT = 1 << 53
LONGS = (-(1 << 63), (1 << 63) - 1)


def whole_numbers(vectors: pa.Array, scale: float) -> np.ndarray:
    """One row of floor(scale * x) for each list; shorter ones end in zeros. Doubles, or integers where those are not exact."""
    lengths = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, int)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with zeros for the columns that the other one has in addition, and of Python's integers if doubles may be inexact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width >= EXACT:
        a, b = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b))
    return a, b


class Lists:
    """The rows of a block in the order of each dimension."""

    def __init__(self, rows: np.ndarray):
        self.rows, n = rows, len(rows)
        self.order = np.argsort(rows, axis=0, kind="stable").T  # (dimension, place), ascending
        self.depths, depth = [], max(1, n // 256)
        while depth < n:
            self.depths.append(depth)
            depth *= 4
        self.depths.append(n)
        read = [0, *(d - 1 for d in self.depths[:-1])]  # the place read last (before any: the first)
        ordered = np.take_along_axis(rows, self.order.T, axis=0)
        self.low, self.high = ordered[read].T, ordered[[n - 1 - r for r in read]].T

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """For each anchor, the most that a row may score that was not met down to each depth (0 first)."""
        up, down = np.where(anchors > 0, anchors, 0), np.where(anchors < 0, anchors, 0)
        return up @ self.high + down @ self.low

    def search(self, anchor: np.ndarray, thresholds: np.ndarray, least: Callable[[], float],
               offer: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Offer rows and their scores until no other row can reach ``least()``."""
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        n, begin = len(self.rows), 0
        met = np.zeros(n, bool)
        for depth, threshold in zip(self.depths, thresholds, strict=True):
            if threshold < least():
                return
            new = np.zeros(n, bool)
            new[self.order[up, n - depth: n - begin]] = True
            new[self.order[down, begin:depth]] = True
            if not len(up) and not len(down):
                new[:] = True  # all score 0
            new &= ~met
            met |= new
            begin = depth
            found = np.flatnonzero(new)
            if len(found):
                offer(found, self.rows[found] @ anchor)


class Best:
    """The first ``k`` of the offered (score, id) within [low, high]."""

    def __init__(self, k: int, low: float = -inf, high: float = inf):
        self.k, self.low, self.high, self.held = k, low, high, []

    @property
    def least(self) -> float:
        return -self.held[-1][0] if len(self.held) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero((scores >= self.least) & (scores <= self.high))
        if len(at) > 4 * self.k:  # of these, all that tie with the k-th or are better
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
            if len(at) > 4 * self.k:
                at = at[np.lexsort((ids[at], -scores[at]))[: self.k]]
        if len(at):
            some = [(-int(s), int(i)) for s, i in zip(scores[at], ids[at], strict=True)]
            self.held = sorted(self.held + some)[: self.k]


def _blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, ids, labels, whole numbers) of about BLOCK_VALUES components; a longer vector is a block of its own."""
    parts, values = [], 0

    def cut():
        at = pa.Table.from_batches(parts).combine_chunks()
        return (*(at.column(c).to_numpy() for c in ("key", "id", "label")), whole_numbers(at.column("vector").combine_chunks(), scale))
    for batch in batches:
        sizes = np.diff(batch.column("vector").offsets.to_numpy()) + 1
        begin = 0
        while begin < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[begin:]), BLOCK_VALUES - values, side="right")
            end = begin + int(max(room, 0 if parts else 1))
            if end > begin:
                parts.append(batch.slice(begin, end - begin))
                values += int(sizes[begin:end].sum())
            if end < batch.num_rows:
                yield cut()
                parts, values = [], 0
            begin = end
    if parts:
        yield cut()


def _positives(anchors, k: int, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first ``k`` other rows of each anchor's label among a partition's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, labels, vectors, _ = anchors.value
        best = [Best(k) for _ in keys]
        for row_keys, row_ids, row_labels, rows in _blocks(batches, scale):
            here = np.flatnonzero(np.isin(labels, row_labels))
            if not len(here):
                continue
            of, rows = same_width(vectors[here], rows)
            lists = Lists(rows)
            bounds = lists.thresholds(of)
            for j, anchor, thresholds in zip(here, of, bounds, strict=True):
                def offer(found: np.ndarray, scores: np.ndarray, j: int = j) -> None:
                    mine = (row_labels[found] == labels[j]) & (row_keys[found] != keys[j])
                    best[j].offer(scores[mine], row_ids[found][mine])
                lists.search(anchor, thresholds, lambda j=j: best[j].least, offer)
        found = [(int(keys[j]), int(ids[j]), i, _long(-s)) for j, b in enumerate(best) for s, i in b.held]
        yield _table(found, ["anchor", "anchor_id", "id", "score"])
    return run


def _negatives(anchors, k: int, low: int, high: int, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first ``k`` rows of other labels in each window of each anchor among a partition's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, labels, vectors, positives = anchors.value
        # Positives of the same score share a window; one that ends below its start is empty.
        windows = [{p["score"]: Best(k, -(-low * p["score"] // 100), high * p["score"] // 100) for p in own} for own in positives]
        windows = [{s: w for s, w in own.items() if w.low <= w.high} for own in windows]
        for _, row_ids, row_labels, rows in _blocks(batches, scale):
            here = np.array([j for j, own in enumerate(windows) if own and (row_labels != labels[j]).any()], int)
            if not len(here):
                continue
            of, rows = same_width(vectors[here], rows)
            lists = Lists(rows)
            bounds = lists.thresholds(of)
            for j, anchor, thresholds in zip(here, of, bounds, strict=True):
                own = list(windows[j].values())

                def offer(found: np.ndarray, scores: np.ndarray, j: int = j, own: list[Best] = own) -> None:
                    other = row_labels[found] != labels[j]
                    scores, some = scores[other], row_ids[found][other]
                    for w in own:
                        w.offer(scores, some)
                lists.search(anchor, thresholds, lambda own=own: min(w.least for w in own), offer)
        found = [(int(keys[j]), int(ids[j]), p["place"], p["id"], p["score"], i, _long(-s))
                 for j, own in enumerate(positives) for p in own if p["score"] in windows[j]
                 for s, i in windows[j][p["score"]].held]
        yield _table(found, ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])
    return run


def _long(x: int) -> int:
    return min(max(int(x), LONGS[0]), LONGS[1])


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)


def _groups(anchors: DataFrame, scale: float) -> Iterator:
    """Broadcasts of the anchors' (keys, ids, labels, whole numbers, positives), GROUP_BYTES of vectors each."""
    spark = anchors.sparkSession
    size = anchors.agg(F.sum(F.size("vector") * 8 + 200)).first()[0] or 0
    n = max(1, -(-size // GROUP_BYTES))
    for g in range(n):
        part = anchors.where(F.pmod(F.xxhash64("key"), F.lit(n)) == g).toArrow().combine_chunks()
        if part.num_rows:
            positives = part.column("positives").to_pylist() if "positives" in part.column_names else None
            vectors = part.column("vector").combine_chunks()
            yield spark.sparkContext.broadcast((*(part.column(c).to_numpy() for c in ("key", "id", "label")),
                                                whole_numbers(vectors, scale), positives))


def _searched(rows: DataFrame, anchors: DataFrame, search: Callable, scale: float, schema: str) -> DataFrame:
    """All that the tasks find for the anchors, group by group."""
    out = rows.sparkSession.createDataFrame([], schema)
    for held in _groups(anchors, scale):
        out = out.unionAll(rows.select("key", "id", "label", "vector").mapInArrow(search(held), schema))
    return out


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", *, scale: float = 256.0, n_positives: int = 5, n_negatives: int = 5,
                   low: int = 80, high: int = 100) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank (from 1), negative_id, positive_score
    and negative_score.

    ``anchor`` is a condition on the input's columns; ids and labels are whole numbers.
    """
    numbers = F.col(vector_col)
    usable = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & numbers.isNotNull()
              & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf))))
    rows = vectors.where(usable).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), numbers.alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    # Stored, so that a row keeps its key; by label, so that blocks are of few labels.
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()).sortWithinPartitions("label"), "vectors")
    anchors = rows.where("is_anchor")
    found = _searched(rows, anchors, lambda held: _positives(held, n_positives, scale), scale,
                      "anchor long, anchor_id long, id long, score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n_positives)
    positives = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    anchors = stored(anchors.join(positives, anchors["key"] == positives["anchor"]).select(
        "key", "id", "label", "vector", "positives"), "anchors")
    found = _searched(rows, anchors, lambda held: _negatives(held, n_negatives, low, high, scale), scale,
                      "anchor long, anchor_id long, place long, positive_id long, positive_score long, negative_id long,"
                      " negative_score long")
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
