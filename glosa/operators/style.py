"""Writing-style vectors (G6–G10, E4): windows → padded tensors → model → document.

A style model reads windows of a text as numbers: words ``[T_w]``, characters
``[T_w, T_c]``, the window's and each word's length. Windows are ragged, the model's
tensors are not: the windows of an Arrow batch are dealt into buckets by their number of
words and longest word, each bucket is padded to its own bounds only, and goes through
the model with four tensors a row. Padding is therefore at most fourfold on each side
beyond the smallest bucket, a bound that holds whatever the texts.

Every window is scored: it comes back as a score and a vector, and the document vector
is their softmax pooling over the windows, taken where they are scored, so that a row a
text leaves the task. A text without tokens has zeros. Words beyond
the vocabulary, and characters beyond the alphabet, get the id of ``<UNK>``; 0 is
padding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosa.columns import COMMENT_ID, TEXT
from glosa.operators.attention import softmax_pool
from glosa.operators.joins import frequent_keys
from glosa.operators.lookups import TEXT_KEY, Alphabet, _unk_id, char_ids, offsets, text_key
from glosa.operators.words import word_frequencies, words_of
from glosa.session import cut_lineage

BATCH = 256
STEP = 4  # from one bucket's bound to the next
LEAST_CHARS = 8
CELLS = 4_000_000  # of a call's character tensor
SLICE_CHARS = 1_000_000  # of the texts whose windows leave a task together
CODEC = "zstd"  # of texts that move
FREQUENT_WORDS = 200_000  # sent to all tasks: some 40 MB as a dictionary


@dataclass
class StyleModel:
    """``make_predict_fn() -> (words [B, T_w], chars [B, T_w * T_c], word lengths [B, T_w], window lengths [B]) -> [B, 1 + dim]``:
    a window's attention score, then its vector."""
    make_predict_fn: Callable
    dim: int
    word_vocab: DataFrame  # (token, id)
    char_vocab: DataFrame
    window: int = 25
    hop: int = 20
    name: str = "style"

    def key(self) -> str:
        return f"{self.name}:{self.dim}:{self.window}:{self.hop}"


def _texts(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(key, text, its bytes) of each distinct (id, text); texts are compressed, as they move."""
    @F.arrow_udf("struct<text:binary,size:bigint>")
    def packed(column: pa.Array) -> pa.Array:
        codec, out = pa.Codec(CODEC), []
        for text in column.cast(pa.binary()):
            raw = text.as_py()
            out.append(None if raw is None else {"text": codec.compress(raw, asbytes=True), "size": len(raw)})
        return pa.array(out, pa.struct([("text", pa.binary()), ("size", pa.int64())]))
    key = F.struct(F.col(id_col).alias("id"), *text_key(F.col(text_col))).alias("key")
    return df.select(key, packed(F.col(text_col)).alias("_text")).dropDuplicates(["key"])


@dataclass
class WordTable:
    """Ids of words: the most frequent words' go to every task, others are looked up for the texts that have them."""
    frequent: dict[str, int]  # FREQUENT_WORDS at most, the unknown among them with the id of <UNK>
    tokens: DataFrame  # (token): the same words
    vocab: DataFrame  # (token, word_id): all
    unk: int
    alphabet: Alphabet


def word_table(df: DataFrame, model: StyleModel, text_col: str = TEXT) -> WordTable:
    """The ids of the words of the texts."""
    unk = _unk_id(model.word_vocab)
    ids = model.word_vocab.where(F.col("token").isNotNull() & F.col("id").isNotNull())
    ids = ids.select("token", F.col("id").cast("int").alias("word_id"))
    hot = frequent_keys(word_frequencies(df, F.col(text_col)), "token", FREQUENT_WORDS)
    found = hot.join(ids.join(F.broadcast(hot), "token", "left_semi").groupBy("token").agg(F.min("word_id").alias("word_id")), "token", "left")
    held = found.toArrow()  # FREQUENT_WORDS rows at most
    frequent = {t: unk if i is None else i for t, i in zip(held.column("token").to_pylist(), held.column("word_id").to_pylist())}
    return WordTable(frequent, hot, ids, unk, Alphabet(model.char_vocab))


def encoded_windows(df: DataFrame, words: WordTable, model: StyleModel, text_col: str = TEXT, id_col: str = COMMENT_ID) -> DataFrame:
    """One row a window: key (id, text key), window_idx, its words' ids, the ids of all their characters and the words' lengths."""
    rows, encode, schema = _window_encoder(df, words, model, text_col, id_col)
    return rows.mapInArrow(encode, schema)


def _window_encoder(df: DataFrame, words: WordTable, model: StyleModel, text_col: str, id_col: str) -> tuple[DataFrame, Callable, T.StructType]:
    """Texts with the ids of their rarer words, the function of batches that makes windows of them, and its schema.

    A text moves once. Of its words only the rarer ones do, once a text, and come back to
    it as a map; windows are cut and encoded where the text lies, in Arrow batches."""
    texts = _texts(df, text_col, id_col)
    held = df.sparkSession.sparkContext.broadcast(words.frequent)

    @F.arrow_udf("array<string>")
    def rarer(column: pa.Array) -> pa.Array:
        frequent = held.value
        return pa.array([[w for w in set(own or ()) if w not in frequent] for own in words_of(column)], pa.list_(pa.string()))
    key = F.struct(F.col(id_col).alias("id"), *text_key(F.col(text_col))).alias("key")
    rare = df.select(key, F.explode(rarer(F.col(text_col))).alias("token"))
    # Words are made one in the vocabulary, which is small, and not in the texts' pairs: a copy in a text's map says the same.
    rare = rare.join(words.vocab.groupBy("token").agg(F.min("word_id").alias("word_id")), "token")
    rare = rare.groupBy("key").agg(F.collect_list("token").alias("rare"), F.collect_list("word_id").alias("rare_ids"))
    rows = texts.join(rare, "key", "left").select("key", "_text", "rare", "rare_ids")
    unk, alphabet, window, hop = words.unk, words.alphabet, model.window, model.hop

    def lists(values: list[np.ndarray], sizes: list[np.ndarray]):
        return pa.ListArray.from_arrays(pa.array(offsets(np.concatenate(sizes))), pa.array(np.concatenate(values).astype(np.int32)))

    def window_parts(text: str, own: dict[str, int], frequent: dict[str, int], table: np.ndarray):
        """Windows' numbers, and of each its word ids, their number, characters, their number and word lengths."""
        toks = text.split()
        word_ids = np.array([i if (i := frequent.get(t)) is not None else own.get(t, unk) for t in toks], np.int32)
        chars, sizes = char_ids(toks, table)
        starts = np.arange(0, len(toks), hop)
        n = np.minimum(window, len(toks) - starts)
        of_words, ends = _ranges(starts, n), offsets(sizes)
        n_chars = ends[starts + n] - ends[starts]
        return np.arange(len(starts), dtype=np.int32), word_ids[of_words], n, chars[_ranges(ends[starts], n_chars)], n_chars, sizes[of_words]

    def whole(keys: pa.Array, places: list[int], parts: list[tuple]) -> pa.RecordBatch:
        number, word_ids, n, chars, n_chars, sizes = ([*x] for x in zip(*parts))
        of = np.repeat(places, [len(x) for x in number])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(np.concatenate(number)), lists(word_ids, n), lists(chars, n_chars),
                                           lists(sizes, n)], names=["key", "window_idx", "word_ids", "char_ids", "lengths"])

    def encode(batches, blank: list[pa.Array] | None = None):
        """Windows of the texts; the keys of texts without words go to ``blank``."""
        frequent, table, codec = held.value, alphabet.table(), pa.Codec(CODEC)
        for batch in batches:
            keys, texts, places, parts, size, without = batch.column("key"), batch.column("_text"), [], [], 0, []
            for at in range(batch.num_rows):
                own = texts[at].as_py()
                text = codec.decompress(own["text"], own["size"], asbytes=True).decode("utf-8", "replace") if own and own["size"] else ""
                if not text or text.isspace():
                    without.append(at)
                    continue
                own = dict(zip(batch.column("rare")[at].as_py() or [], batch.column("rare_ids")[at].as_py() or []))
                places.append(at)
                parts.append(window_parts(text, own, frequent, table))
                size += len(text)
                if size >= SLICE_CHARS:
                    yield whole(keys, places, parts)
                    places, parts, size = [], [], 0
            if blank is not None and without:
                blank.append(keys.take(pa.array(without)))
            if places:
                yield whole(keys, places, parts)
    schema = T.StructType([rows.schema["key"], T.StructField("window_idx", T.IntegerType()),
                           *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("word_ids", "char_ids", "lengths")]])
    return rows, encode, schema


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, …, start + size - 1 of each, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before, sizes) + np.repeat(starts, sizes)


def _bounds(sizes: np.ndarray, least: int) -> np.ndarray:
    """For each the smallest of least, least * STEP, … that is not smaller."""
    out = np.full(len(sizes), least, np.int64)
    while (short := out < sizes).any():
        out[short] *= STEP
    return out


def window_scorer(model: StyleModel) -> Callable:
    """Of batches of encoded windows the batches of ``(key, window_idx, score, vector)``: each is dealt into buckets, padded and scored."""
    make, dim, window = model.make_predict_fn, model.dim, model.window
    small = -(-window // STEP)

    def score(batches):
        predict = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            words, chars, lengths = (batch.column(c) for c in ("word_ids", "char_ids", "lengths"))
            values = [c.flatten().to_numpy(zero_copy_only=False) for c in (words, chars, lengths)]
            n = np.diff(words.offsets.to_numpy())
            first, first_char = offsets(n)[:-1], offsets(np.diff(chars.offsets.to_numpy()))[:-1]
            longest = np.maximum.reduceat(values[2], first)
            t_w, t_c = np.where(n <= small, small, window), _bounds(longest, LEAST_CHARS)
            out = np.empty((batch.num_rows, 1 + dim))
            for w, c in sorted({*zip(t_w.tolist(), t_c.tolist())}):
                bucket, step = np.flatnonzero((t_w == w) & (t_c == c)), max(1, min(BATCH, CELLS // (w * c)))
                for a in range(0, len(bucket), step):
                    at = bucket[a: a + step]
                    out[at] = predict(*_padded(values, first[at], first_char[at], n[at], w, c))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("window_idx"), pa.array(out[:, 0]),
                                              pa.FixedSizeListArray.from_arrays(pa.array(out[:, 1:].ravel()), dim).cast(pa.list_(pa.float64()))],
                                             names=["key", "window_idx", "score", "vector"])
    return score


def _scored(key: T.StructField) -> T.StructType:
    return T.StructType([key, T.StructField("window_idx", T.IntegerType()), T.StructField("score", T.DoubleType()),
                         T.StructField("vector", T.ArrayType(T.DoubleType()))])


def window_outputs(windows: DataFrame, model: StyleModel) -> DataFrame:
    """``(key, window_idx, score, vector)`` of all encoded windows."""
    return windows.mapInArrow(window_scorer(model), _scored(windows.schema["key"]))


def scored_windows(df: DataFrame, words: WordTable, model: StyleModel, text_col: str = TEXT, id_col: str = COMMENT_ID) -> DataFrame:
    """``window_outputs`` of ``encoded_windows``; windows are scored by the task that encodes them."""
    rows, encode, schema = _window_encoder(df, words, model, text_col, id_col)
    score = window_scorer(model)
    return rows.mapInArrow(lambda batches: score(encode(batches)), _scored(schema["key"]))


def pooled_windows(df: DataFrame, words: WordTable, model: StyleModel, text_col: str = TEXT, id_col: str = COMMENT_ID) -> DataFrame:
    """``(key, score, vector)``: the windows of each text, pooled by the task that scores them.

    All windows of a text leave ``encode`` in one batch, so a row stands for all of them: its
    vector is their softmax pooling, its score the logarithm of their weights' sum, by which it
    can be pooled with others. A text without words has zeros."""
    rows, encode, schema = _window_encoder(df, words, model, text_col, id_col)
    score, dim = window_scorer(model), model.dim

    def part(keys: pa.Array, scores: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), dim).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([keys, pa.array(scores), lists], names=["key", "score", "vector"])

    def pool(batches):
        blank: list[pa.Array] = []
        for batch in score(encode(batches, blank)):
            first = np.flatnonzero(batch.column("window_idx").to_numpy() == 0)
            scores = batch.column("score").to_numpy()
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            top = np.maximum.reduceat(scores, first)
            weights = np.exp(scores - np.repeat(top, np.diff(np.append(first, len(scores)))))
            sums = np.add.reduceat(weights, first)
            yield part(batch.column("key").take(pa.array(first)), top + np.log(sums),
                       np.add.reduceat(weights[:, None] * vectors, first, axis=0) / sums[:, None])
            yield from (part(keys, np.zeros(len(keys)), np.zeros((len(keys), dim))) for keys in blank)
            blank.clear()
        yield from (part(keys, np.zeros(len(keys)), np.zeros((len(keys), dim))) for keys in blank)
    parts = T.StructType([schema["key"], T.StructField("score", T.DoubleType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(pool, parts)


def _padded(values: list[np.ndarray], first: np.ndarray, first_char: np.ndarray, n: np.ndarray, t_w: int, t_c: int) -> list[np.ndarray]:
    """The four tensors of some windows: words, characters, word lengths, window lengths."""
    words, chars, lengths = values
    rows, places, own = np.repeat(np.arange(len(n)), n), _ranges(np.zeros_like(n), n), _ranges(first, n)
    ids, sizes = np.zeros((len(n), t_w), np.int64), np.zeros((len(n), t_w), np.int64)
    ids[rows, places], sizes[rows, places] = words[own], lengths[own]
    size = lengths[own].astype(np.int64)
    n_chars = sizes.sum(axis=1)
    letters = np.zeros((len(n), t_w * t_c), np.int32)
    letters[np.repeat(rows, size), _ranges(places * t_c, size)] = chars[_ranges(first_char, n_chars)]
    return [ids, letters, sizes, n.astype(np.int64)]


def style_vectors(df: DataFrame, model: StyleModel, out: str = "style", text_col: str = TEXT, id_col: str = COMMENT_ID) -> DataFrame:
    """The document vector of each distinct (id, text): id, text key and ``out``."""
    words = word_table(df, model, text_col)
    parts = cut_lineage(pooled_windows(df, words, model, text_col, id_col))  # texts and their rarer words are not needed any more
    # A text has one row already: dealt by its key once, its sums are made where it lies.
    pooled = softmax_pool(parts.repartition("key"), "key", "score", "vector", out=out, dim=model.dim)
    return pooled.select(F.col("key.id").alias(id_col), *[f"key.{c}" for c in TEXT_KEY], out)


def _style_numbers(weights, words, chars, lengths, n_words):
    x = np.stack([words.sum(axis=1), chars.sum(axis=1), lengths.sum(axis=1), n_words], axis=1).astype(float) / 10_000.0
    return x @ weights


def style_weights(dim: int, seed: int = 5):
    """Seeded weights of the stand-in model on its four sums: the score's first."""
    return np.random.default_rng(seed).standard_normal((4, 1 + dim))


def seeded_style_model(dim: int, seed: int = 5) -> Callable:
    """``make_predict_fn`` of a stand-in: score and vector linear in the window's sums of word ids,
    character ids and word lengths and its number of words (each a ten-thousandth). Padding adds nothing."""
    def make():
        import functools
        return functools.partial(_style_numbers, style_weights(dim, seed))
    return make
