"""Operator 10: benchmark passages in documents by Wu-Manber search.

Texts are words: A-Z lower-cased, ASCII other than letters and digits parts
them. The strings that are sought are the windows of ``window`` consecutive
words of each benchmark item; an item of fewer words, but not none, is one
string. Strings of equal length are sought together:

* a shift table says, for each block of two words, how far the search may move
  on when it has read that block (the least distance of the block from the end
  of any string that has it, or the most there is for other blocks);
* a block that ends strings selects those by that suffix, then by their first
  block;
* a direct comparison of the words confirms an occurrence.

Words are numbers: the benchmark's distinct words, numbered from 1; any other word is
in no string. Strings are places in one array of numbers, their suffix table sorted
arrays of 64-bit keys and the shift table a dictionary of them, all built once per
worker process and block. The benchmark is cut into blocks of bounded
bytes, each sent to all tasks; documents are not shuffled, and one pass over them seeks
all blocks: a batch is cut into words once. An item longer than the bound is a block
of its own.

A null text has no words. An item without words is never found. A null item_id
marks words as hit like others but is not listed. Repeated rows and ids of
documents are searched like others; rows of one item_id are one item.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import slices

SLICE_BYTES = 4_000_000
MATCHERS_KEPT = 2
# Each byte of a text: lower case for letters, itself for digits and non-ASCII, else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Strings:
    """Wu-Manber tables over strings of ``m`` words: ``words`` (numbers) from each of ``starts`` on, with the item of each.

    Strings are kept as places in ``words``; tables hold each distinct one once."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, items: np.ndarray, m: int, width: int):
        self.m, self.width, self.words = m, width, words
        self.block = min(2, m)
        self.most = m - self.block + 1
        at = np.lexsort((items, *[words[starts + c] for c in range(m - 1, -1, -1)]))
        starts, items = starts[at], items[at]
        new = np.zeros(len(starts), bool)
        new[:1] = True
        for c in range(m):
            column = words[starts + c]
            new[1:] |= column[1:] != column[:-1]
        self.starts = starts[new]
        # The items of string i are items[first[i]: first[i + 1]].
        self.items, self.first = items, np.concatenate((np.flatnonzero(new), [len(items)]))
        self.shift: dict[int, int] = {}
        for end in range(self.block, m + 1):  # from the greatest shift down: a block keeps its last
            self.shift.update(zip(np.unique(self._block_at(end - self.block)).tolist(), repeat(m - end)))
        # Strings by their last block, then their first.
        suffix, prefix = self._block_at(m - self.block), self._block_at(0)
        self.by = np.lexsort((prefix, suffix))
        self.suffix, self.prefix = suffix[self.by], prefix[self.by]

    def _block_at(self, offset: int) -> np.ndarray:
        """Keys of the strings' blocks that begin at their word ``offset``."""
        first = self.words[self.starts + offset].astype(np.int64)
        return first if self.block == 1 else first * self.width + self.words[self.starts + offset + 1]

    def _key(self, block: np.ndarray) -> np.ndarray:
        return block[:, 0] if block.shape[1] == 1 else block[:, 0] * self.width + block[:, 1]

    def occurrences(self, words: list[bytes], number: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, items) of each occurrence, from left to right. Words that are jumped over are not looked up."""
        shift, most, width, m, end, n = self.shift.get, self.most, self.width, self.m, self.m, len(words)
        number, two = number.get, self.block == 2
        while end <= n:
            key = number(words[end - 1])
            if key is not None and two:
                first = number(words[end - 2])
                key = None if first is None else first * width + key
            step = most if key is None else shift(key, most)
            if step:
                end += step
                continue
            here = np.array([number(w, 0) for w in words[end - m: end]], np.int32)
            prefix = int(here[0]) * width + int(here[1]) if two else int(here[0])
            a, b = np.searchsorted(self.suffix, key), np.searchsorted(self.suffix, key, side="right")
            a, b = a + np.searchsorted(self.prefix[a:b], prefix), a + np.searchsorted(self.prefix[a:b], prefix, side="right")
            for i in self.by[a:b].tolist():
                if np.array_equal(self.words[self.starts[i]: self.starts[i] + m], here):
                    yield end - m, self.items[self.first[i]: self.first[i + 1]]
            end += 1


class Matcher:
    """All strings of a block: ``names`` of its items, its words' numbers and the tables by length."""

    def __init__(self, items: list[tuple], window: int):
        self.names: list = []
        names: dict = {}
        self.number: dict[bytes, int] = {}
        texts = []
        for name, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            if words:
                if name not in names:
                    names[name] = len(self.names)
                    self.names.append(name)
                texts.append((names[name], np.array(words, np.int32)))
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, words in texts:
            by_length.setdefault(min(window, len(words)), []).append((k, words))
        self.tables = []
        for m, parts in sorted(by_length.items()):
            sizes = np.array([len(words) for _, words in parts])
            counts, begin = sizes - m + 1, np.cumsum(sizes) - sizes
            starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            self.tables.append(Strings(np.concatenate([words for _, words in parts]), starts,
                                       np.repeat(np.array([k for k, _ in parts], np.int32), counts), m, len(self.number) + 1))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list]]:
        """(first word, end, items) of all occurrences in a text."""
        for table in self.tables:
            for first, of in table.occurrences(words, self.number):
                yield first, first + table.m, [self.names[i] for i in of.tolist()]


# The matchers of this worker process, by the broadcast they are made from.
_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(held, window: int) -> Matcher:
    key, items = held.value
    if (key, window) not in _MATCHERS:
        _MATCHERS[key, window] = Matcher(items, window)
        while len(_MATCHERS) > MATCHERS_KEPT:
            _MATCHERS.pop(next(iter(_MATCHERS)))
    return _MATCHERS[key, window]


def _search(blocks: list, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences in one pass: n_words, starts and ends (of merged runs of hit words) and items of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for part in slices(batches, "text", SLICE_BYTES):
            kind = kind or part.schema.field("items").type
            texts = [words_of(t) for t in part.column("text").to_pylist()]
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for held in blocks:  # the outer loop, so that few tables are in use at a time
                matcher = _matcher(held, window)
                for k, words in enumerate(texts):
                    for first, end, of in matcher.search(words):
                        spans[k].append((first, end))
                        items[k].update(of)
            starts, ends = [], []
            for found in spans:
                merged: list[list[int]] = []
                for a, b in sorted(found):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                starts.append([a for a, _ in merged])
                ends.append([b for _, b in merged])
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
                 pa.array([[i for i in of if i is not None] for of in items], kind)],
                names=["row", "n_words", "starts", "ends", "items"])
    return run


def _blocks(benchmark: DataFrame, max_bytes: int) -> int:
    size = benchmark.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    return max(1, -(-size // max_bytes))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", window: int = 10, block_bytes: int = 16_000_000,
                 carry: list[str] | None = None) -> DataFrame:
    """Benchmark hits of every document.

    Returns ``row`` (a struct of the input's columns, or of those in ``carry``),
    ``n_words``, ``starts`` and ``ends`` (runs of hit words), ``items`` (ids
    whose windows occur), ``n_hit`` and ``contaminated``. An empty benchmark
    leaves every document clean.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    items = items.where("text is not null").distinct()
    kind = items.schema["item"].dataType.simpleString()
    rows = docs.select(F.struct(*(carry if carry is not None else docs.columns)).alias("row"),
                       F.col(text_col).cast("binary").alias("text"), F.expr(f"cast(array() as array<{kind}>)").alias("items"))
    n, held = _blocks(items, block_bytes), []
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        held.append(docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r["item"], bytes(r["text"])) for r in block.collect()])))
    out = rows.mapInArrow(_search(held, window), f"row {rows.schema['row'].dataType.simpleString()}, n_words bigint,"
                                                 f" starts array<int>, ends array<int>, items array<{kind}>")
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("row", "n_words", "starts", "ends", "items", hit.alias("n_hit")).withColumn(
        "contaminated", F.col("n_hit") > 0)
