"""Operator 13: periodic runs of words, by suffix trees.

A run is a stretch of words with a least period q that no neighbouring word extends
with this period, ``min_exponent`` times q words long at least and not under
``min_words``. For a sequence of words:

1. Ukkonen's algorithm builds the suffix trees of the sequence and of its reversal. An
   Euler tour of a tree with the string depth at each step, and range minima over it in
   constant time (minima within blocks and a sparse table over blocks), give the
   longest common extension of any two places: to the right by the first tree, to the
   left by the second.
2. The tree's leaves in order rank the suffixes, once with the words' numbers ascending
   and once descending (the end first in both). The longest Lyndon word from a place
   ends at the next place of a smaller suffix. Each run has its period's Lyndon root
   among the words of one of the two orders: these are the candidates.
3. A candidate is extended in both directions. A run that is long enough has a root
   with at least ``min_exponent - 1`` periods from its start on; the others are not
   looked at to the left, and without any the reversal needs no tree.

Trees are built where runs can be. In a run, each window of three words occurs at
least ``least_count`` times; what is left of a text when windows that occur less often
within their stretch are taken out, again and again until nothing changes, are
stretches that hold all runs whole. Counting windows is done for many texts at once.

Texts are read whole; a tree takes about half a kilobyte a word of its stretch, in the
task of the document. A null or empty text has no words and no runs, and collapses to
an empty text. Repeated rows have their runs each. An empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import slices

SLICE_BYTES = 4_000_000
BLOCK = 16
RUN = "struct<start: bigint, length: bigint, period: bigint>"


class SuffixTree:
    """Suffix tree of a list of positive numbers, with 0 as its end."""

    def __init__(self, letters: list[int]):
        self.letters = [*letters, 0]
        self.n = len(self.letters)
        self.width = max(self.letters) + 1
        self._build()

    def _build(self) -> None:
        """Ukkonen: one pass, with the longest suffix that is not a leaf yet as the active place."""
        s, n, width = self.letters, self.n, self.width
        begin, end, link = array("i", [0]), array("i", [0]), array("i", [0])
        child: dict[int, int] = {}  # node * width + first letter of the edge
        node, edge, length, waiting = 0, 0, 0, 0
        for i, letter in enumerate(s):
            waiting += 1
            made = 0  # inner node of this step without a link
            while waiting:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    at = begin[below]
                    size = end[below] - at
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    if s[at + length] == letter:
                        if made:
                            link[made] = node
                        length += 1
                        break
                    inner = len(begin)
                    begin.append(at)
                    end.append(at + length)
                    link.append(0)
                    child[key] = inner
                    child[inner * width + letter] = inner + 1
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    begin[below] = at + length
                    child[inner * width + s[at + length]] = below
                    if made:
                        link[made] = inner
                    made = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(child, np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int32, len(child))
        del child
        by_key = np.argsort(keys)
        keys, self.child = keys[by_key], nodes[by_key]
        self.letter = keys % width
        self.first = np.searchsorted(keys, np.arange(len(begin) + 1) * width)
        self.size = np.frombuffer(end, np.int32) - np.frombuffer(begin, np.int32)

    def _walk(self, child: np.ndarray, tour: array | None, seen: array | None) -> np.ndarray:
        """Suffixes in the order of the leaves; the Euler tour's depths go to ``tour``, a leaf's place there to ``seen``."""
        n, order = self.n, array("i")
        child, size, at, stop = child.tolist(), self.size.tolist(), self.first[:-1].tolist(), self.first[1:].tolist()
        path, depths, v, depth = [], [], 0, 0
        if tour is not None:
            tour.append(0)
        while True:
            k = at[v]
            if k < stop[v]:
                at[v] = k + 1
                c = child[k]
                below = depth + size[c]
                if at[c] == stop[c]:  # a leaf: inner nodes have children, and are entered once
                    order.append(n - below)
                    if tour is not None:
                        seen[n - below] = len(tour)
                        tour.append(below)
                        tour.append(depth)
                else:
                    path.append(v)
                    depths.append(depth)
                    v, depth = c, below
                    if tour is not None:
                        tour.append(depth)
            elif path:
                v, depth = path.pop(), depths.pop()
                if tour is not None:
                    tour.append(depth)
            else:
                return np.frombuffer(order, np.int32)

    def euler(self) -> np.ndarray:
        """Make ``extension`` ready; returns the suffixes in ascending order."""
        tour, seen = array("i"), array("i", bytes(4 * self.n))
        order = self._walk(self.child, tour, seen)
        self.seen = np.frombuffer(seen, np.int32).astype(np.int64)
        depths = np.frombuffer(tour, np.int32)
        depths = np.concatenate((depths, np.full(-len(depths) % BLOCK, np.iinfo(np.int32).max, np.int32))).reshape(-1, BLOCK)
        self.depths = depths
        self.upto = np.minimum.accumulate(depths, axis=1).ravel()
        self.onward = np.minimum.accumulate(depths[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [depths.min(axis=1)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))
        return order

    def descending(self) -> np.ndarray:
        """The suffixes in order with letters descending; the end still comes first."""
        parent = np.searchsorted(self.first, np.arange(len(self.child)), side="right") - 1
        by = np.lexsort((np.where(self.letter == 0, 0, self.width - self.letter), parent))
        return self._walk(self.child[by], None, None)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes i and j (i and j differ), by the depth of their lowest common ancestor."""
        a, b = np.minimum(self.seen[i], self.seen[j]), np.maximum(self.seen[i], self.seen[j])
        left, right = a // BLOCK, b // BLOCK
        out = np.minimum(self.onward[a], self.upto[b])
        inside = np.flatnonzero(left == right)
        if len(inside):
            places = np.arange(BLOCK)
            some = self.depths[left[inside]]
            within = (places >= (a[inside] % BLOCK)[:, None]) & (places <= (b[inside] % BLOCK)[:, None])
            out[inside] = np.where(within, some, np.iinfo(np.int32).max).min(axis=1)
        between = right - left - 1
        level = np.frexp(np.maximum(between, 1))[1] - 1  # the largest power of two that is not longer
        for k in range(len(self.table)):
            at = np.flatnonzero((between > 0) & (level == k))
            if len(at):
                row = self.table[k]
                out[at] = np.minimum(out[at], np.minimum(row[left[at] + 1], row[right[at] - (1 << k)]))
        return out


def lyndon_ends(order: np.ndarray, n: int) -> np.ndarray:
    """Where the longest Lyndon word from each of n places ends: at the next smaller suffix."""
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.arange(n + 1)
    rank = rank.tolist()
    ends = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, rank[i]
        while j < n and rank[j] > own:
            j = ends[j]
        ends[i] = j
    return np.array(ends, np.int64)


def runs_of(letters: list[int], min_words: int, min_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of positive numbers, by start, then period."""
    n = len(letters)
    tree = SuffixTree(letters)
    begin = np.arange(n)
    ends = (lyndon_ends(tree.euler(), n), lyndon_ends(tree.descending(), n))
    roots = np.unique(np.concatenate([np.stack((begin, e - begin), axis=1)[e < n] for e in ends]), axis=0)
    i, p = roots[:, 0], roots[:, 1]
    if len(roots):
        right = p + tree.extension(i, i + p)
        far = right >= (min_exponent - 1) * p
        i, p, right = i[far], p[far], right[far]
    if not len(i):
        return np.empty((0, 3), np.int64)
    back = SuffixTree(letters[::-1])
    back.euler()
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = back.extension(n - i[inner], n - i[inner] - p[inner])
    out = np.stack((i - left, left + right, p), axis=1)
    return np.unique(out[out[:, 1] >= np.maximum(min_words, min_exponent * p)], axis=0)[:, [0, 1, 2]] if len(out) else out


def least_count(min_words: int, min_exponent: int) -> int:
    """How often each window of three words of a run occurs in it at least."""
    return min(min_exponent - 1, max(min_words, min_exponent) - 2)


def stretches(letters: np.ndarray, text: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words that can hold runs; ``text`` numbers the texts that the words are of."""
    if len(letters) < 3:
        return []
    width = int(letters.max()) + 1
    pairs = letters[:-1].astype(np.int64) * width + letters[1:]
    pairs = np.unique(pairs, return_inverse=True)[1]
    windows = np.unique(pairs[:-1] * width + letters[2:], return_inverse=True)[1]
    at = np.flatnonzero(text[:-2] == text[2:])
    part = text[at].astype(np.int64)  # first by text, then by stretch
    count, least = least_count(min_words, min_exponent), max(min_words, min_exponent) - 2
    kinds = int(windows.max(initial=0)) + 1
    while len(at):
        _, kind, n = np.unique(part * kinds + windows[at], return_inverse=True, return_counts=True)
        often = n[kind] >= count
        left, of = at[often], part[often]
        cut = np.concatenate(([True], (np.diff(left) != 1) | (np.diff(of) != 0))) if len(left) else np.empty(0, bool)
        part = np.cumsum(cut) - 1
        long = np.bincount(part, minlength=1)[part] >= least if len(left) else np.empty(0, bool)
        left, part = left[long], part[long]
        if len(left) == len(at):
            break
        at = left
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate(([True], np.diff(part) != 0)))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return [(int(at[a]), int(at[b]) + 3) for a, b in zip(first, last, strict=True)]


def best_run(runs: np.ndarray) -> int:
    """The run of the greatest exact length / period, then least start and period."""
    ratio = runs[:, 1] / runs[:, 2]
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9))
    return int(min(near, key=lambda k: (-Fraction(int(runs[k, 1]), int(runs[k, 2])), runs[k, 0], runs[k, 2])))


def _find(min_words: int, min_exponent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            texts = [(t or b"").split() for t in part.column("text").to_pylist()]
            words = [w for t in texts for w in t]
            sizes = np.array([len(t) for t in texts], np.int64)
            starts = np.cumsum(sizes) - sizes
            number = {w: k for k, w in enumerate(dict.fromkeys(words), 1)}
            letters = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            of = np.repeat(np.arange(len(texts)), sizes)
            found: list[list[np.ndarray]] = [[] for _ in texts]
            kept = np.ones(len(words) + 1, bool)
            for a, b in stretches(letters, of, min_words, min_exponent):
                own, dense = np.unique(letters[a:b], return_inverse=True)
                runs = runs_of((dense + 1).tolist(), min_words, min_exponent)
                for start, length, period in runs.tolist():
                    kept[a + start + period: a + start + length] = False
                if len(runs):
                    k = int(of[a])
                    found[k].append(runs + [a - int(starts[k]), 0, 0])
            rows, best, collapsed = [], [], []
            for k, t in enumerate(texts):
                runs = np.concatenate(found[k]) if found[k] else np.empty((0, 3), np.int64)
                rows.append(runs)
                best.append(dict(zip(("start", "length", "period"), runs[best_run(runs)].tolist(), strict=True)) if len(runs) else None)
                if len(runs):
                    t = [t[j] for j in np.flatnonzero(kept[starts[k]: starts[k] + sizes[k]]).tolist()]
                collapsed.append(b" ".join(t))
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            every = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
            struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, c])) for c in range(3)],
                                                ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), struct),
                 pa.array(best, struct.type), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["row", "n_words", "runs", "best", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, text_col: str = "text", *, min_words: int = 6, min_exponent: int = 4,
                  carry: list[str] | None = None) -> DataFrame:
    """Runs of every document.

    Returns ``row`` (a struct of the input's columns, or of those in ``carry``),
    ``n_words``, ``runs`` (start, length and period in words, by start, then
    period), ``best`` (the run of the greatest exponent, then least start and
    period; null without runs) and ``collapsed``: the words that are in no run, or
    in the first period of each run that has them, joined by spaces.
    """
    if min_words < 3 or min_exponent < 2:
        raise ValueError("runs have three words and two periods at least")
    rows = docs.select(F.struct(*(carry if carry is not None else docs.columns)).alias("row"),
                       F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_find(min_words, min_exponent),
                           f"row {kind}, n_words bigint, runs array<{RUN}>, best {RUN}, collapsed string")
