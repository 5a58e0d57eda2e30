"""Token lookups (G2, G5, G7, G8): explode tokens, join a keyed table, fold back.

A text's tokens are counted first, so that a row stands for all its occurrences of a
token; word vectors and lexicon are merged into one lookup table and joined once. Where
that is too large to broadcast, its rows of the most frequent tokens are, and are added up
where the texts lie; a rarer token's vector is shuffled once for each group of texts that
has it.
Vectors travel and add up in blocks of ``BLOCK_DIMS`` dimensions: a grouped sum of a
few columns whatever the width, with map-side combining and bounded state, so that a
long document never has its token rows collected.

Rows are told apart by id and text (a 128-bit hash of it): repeated and null ids keep
their own results, and rows that are equal in both have equal ones. Documents without
hits (or without tokens) still come out, with zeros.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosa.columns import COMMENT_ID, TEXT
from glosa.functions.text import tokens
from glosa.operators.joins import DEFAULT_BROADCAST_BYTES, fits_broadcast, frequent_keys, layered_join, lookup_join
from glosa.operators.windows import check_window
from glosa.operators.words import counted_words, word_frequencies, words_of
from glosa.session import cut_lineage
from glosa.sources.lookups import UNK

BLOCK_DIMS = 32
HELD_WORDS = 200_000  # sent to all tasks with their vectors, at most
NEAR_ROWS = 4096  # of a text's vectors added up at once
# Rounds of the words that are not sent to all tasks, pairs of text and word from which on there is another, and pairs of a group of texts.
FAR_ROUNDS, FAR_PAIRS, GROUP_PAIRS = 4, 250_000, 8_000_000
TEXT_KEY = ["_h1", "_h2"]


def text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text (null has its own)."""
    return [F.xxhash64(text, F.lit(seed)).alias(name) for seed, name in enumerate(TEXT_KEY)]


def join_by_text(df: DataFrame, results: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Every row of ``df`` with the results of its (id, text); ids may be null."""
    return join_by_key(df.select("*", *text_key(F.col(text_col))), results, id_col).drop(*TEXT_KEY)


def join_by_key(left: DataFrame, results: DataFrame, id_col: str) -> DataFrame:
    """Every row of ``left``, which has its text's key, with the results of its (id, text key); ids may be null."""
    right = results.withColumnRenamed(id_col, "_id")
    for name in TEXT_KEY:
        right = right.withColumnRenamed(name, f"{name}_r")
    on = F.col(id_col).eqNullSafe(F.col("_id"))
    for name in TEXT_KEY:
        on = on & (F.col(name) == F.col(f"{name}_r"))
    return left.join(right, on, "left").drop("_id", *[f"{n}_r" for n in TEXT_KEY])


def token_counts(df: DataFrame, text_col: str, id_col: str, lower: bool = True) -> DataFrame:
    """(id, text key, token, _c): occurrences of each token; a text without tokens has one row with a null token and 0.

    Equal rows become one. Words are counted where a text lies; the counts move once, by id and
    key, and all later sums of a text find its rows where they are."""
    text = F.lower(F.col(text_col)) if lower else F.col(text_col)
    keys = [id_col, *TEXT_KEY]
    texts = df.select(id_col, *text_key(F.col(text_col)), counted_words(text).alias("_w")).dropDuplicates(keys)
    return texts.select(*keys, F.explode("_w").alias("_w")).select(*keys, "_w.token", "_w._c")


def merged_lookup(word_vectors: DataFrame | None, dim: int, lexicon: DataFrame | None) -> DataFrame:
    """One row a token: its vector in blocks of BLOCK_DIMS, its polarity."""
    merged = None
    if word_vectors is not None:
        v = F.col("vector").cast("array<double>")
        blocks = F.array(*[F.slice(v, a + 1, min(BLOCK_DIMS, dim - a)) for a in range(0, dim, BLOCK_DIMS)])
        merged = word_vectors.select("token", blocks.alias("_blocks"))
    if lexicon is not None:
        polarity = lexicon.select("token", F.col("polarity").cast("double").alias("polarity"))
        merged = polarity if merged is None else merged.join(polarity, "token", "full")
    return merged


def token_lookup_features(df: DataFrame, *, word_vectors: DataFrame | None = None, dim: int = 0,
                          lexicon: DataFrame | None = None, text_col: str = TEXT, id_col: str = COMMENT_ID,
                          pooled_out: str = "pooled", polarity_out: str = "polarity",
                          strategy: str = "auto") -> DataFrame:
    """G2 and G5 over one token pass and one join, for every row: id and results.

    * pooled (G2): mean over all tokens of their word vector, a miss counting as
      zeros; ``word_vectors`` is ``(token, vector array<double>)``;
    * polarity (G5): mean polarity of the tokens found in ``lexicon(token,
      polarity)``; 0 when none is found.
    """
    rows = df.select(id_col, text_col)
    found = token_lookup_results(rows, word_vectors=word_vectors, dim=dim, lexicon=lexicon, text_col=text_col, id_col=id_col,
                                 pooled_out=pooled_out, polarity_out=polarity_out, strategy=strategy)
    return join_by_text(rows, found, text_col, id_col).drop(text_col)


def token_lookup_results(df: DataFrame, *, word_vectors: DataFrame | None = None, dim: int = 0,
                         lexicon: DataFrame | None = None, text_col: str = TEXT, id_col: str = COMMENT_ID,
                         pooled_out: str = "pooled", polarity_out: str = "polarity", strategy: str = "auto") -> DataFrame:
    """The results of each distinct (id, text): id, text key and the outputs."""
    if word_vectors is None and lexicon is None:
        raise ValueError("give a word-vector table, a lexicon, or both")
    table = merged_lookup(word_vectors, dim, lexicon)
    if word_vectors is not None and lexicon is not None:
        table = cut_lineage(table)  # measured and joined: merge once
    if strategy == "auto":
        strategy = "broadcast" if fits_broadcast(table) else "layered"
    if strategy == "layered" and word_vectors is not None:
        blocks = _layered_blocks(df, table, dim, lexicon is not None, text_col, id_col)
        return _block_results(blocks, dim, lexicon is not None, id_col, pooled_out, polarity_out)
    rows = token_counts(df, text_col, id_col)
    if strategy == "layered":
        rows = layered_join(rows, table, "token", word_frequencies(df, F.lower(F.col(text_col))))
    else:
        rows = lookup_join(rows, table, "token", "left", strategy=strategy, salt_cols=[id_col, *TEXT_KEY])
    keys, sums = [id_col, *TEXT_KEY], [F.sum("_c").alias("_n")]
    if word_vectors is None:
        hit = F.when(F.col("polarity").isNotNull(), F.col("_c"))
        sums += [F.sum(F.col("polarity") * F.col("_c")).alias("_p"), F.sum(hit).alias("_hits")]
        return rows.groupBy(*keys).agg(*sums).select(*keys, _polarity(polarity_out))
    return _block_results(_block_sums(rows, dim, lexicon is not None, keys), dim, lexicon is not None, id_col, pooled_out, polarity_out)


def _polarity(out: str) -> Column:
    return F.coalesce(F.try_divide("_p", "_hits"), F.lit(0.0)).alias(out)


def _block_sums(rows: DataFrame, dim: int, polarity: bool, keys: list[str]) -> DataFrame:
    """(keys, _b, _v, _n, _p, _hits) of joined tokens: of each text and block the sums of the vectors, and once those of the counts."""
    # Counts and polarities belong to a token's first block.
    rows = rows.select(*keys, "_c", *(["polarity"] if polarity else []), F.posexplode_outer("_blocks").alias("_b", "_v"))
    first = F.coalesce("_b", F.lit(0)) == 0
    rows = rows.withColumn("_b", F.coalesce("_b", F.lit(0)))
    wide = min(dim, BLOCK_DIMS)
    block = [F.coalesce(F.sum(F.get("_v", F.lit(j)).cast("double") * F.col("_c")), F.lit(0.0)) for j in range(wide)]
    once = [F.sum(F.when(first, F.col("_c"))).alias("_n")]
    if polarity:
        hit = F.when(first & F.col("polarity").isNotNull(), F.col("_c"))
        once += [F.sum(F.when(first, F.col("polarity") * F.col("_c"))).alias("_p"), F.sum(hit).alias("_hits")]
    return rows.groupBy(*keys, "_b").agg(F.array(*block).alias("_v"), *once)


def _block_results(blocks: DataFrame, dim: int, polarity: bool, id_col: str, pooled_out: str, polarity_out: str) -> DataFrame:
    """The results of each text from its blocks; it has as many rows as blocks."""
    keys = [id_col, *TEXT_KEY]
    texts = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "_v"))).alias("_s"), F.max("_n").alias("_n"),
                                      *([F.max("_p").alias("_p"), F.max("_hits").alias("_hits")] if polarity else []))
    total = F.slice(F.flatten(F.transform("_s", lambda x: x["_v"])), 1, dim)
    total = F.when(F.size(total) == dim, total).otherwise(F.array_repeat(F.lit(0.0), dim))  # no hit: the first block only
    pooled = F.transform(total, lambda x: F.coalesce(F.try_divide(x, F.col("_n")), F.lit(0.0)))
    return texts.select(*keys, pooled.alias(pooled_out), *([_polarity(polarity_out)] if polarity else []))


def _narrowest(table: DataFrame) -> DataFrame:
    """The table with its blocks as floats if no number changes by it, as in tables of trained vectors."""
    def kept(x: Column) -> Column:
        return F.coalesce(x.cast("float").cast("double") == x, F.lit(True))
    exact = F.bool_and(F.forall("_blocks", lambda b: F.coalesce(F.forall(b, kept), F.lit(True))))
    if table.agg(F.coalesce(exact, F.lit(True))).first()[0]:
        return table.withColumn("_blocks", F.col("_blocks").cast("array<array<float>>"))
    return table


@dataclass
class HeldWords:
    """Frequent words that go to all tasks: of each its place, or -1 for one that the table lacks, and by place what the table says."""
    places: dict[str, int]
    vectors: np.ndarray  # sums of a word's rows
    rows: np.ndarray  # their number
    polarity: np.ndarray
    hits: np.ndarray


def _held_words(df: DataFrame, table: DataFrame, dim: int, polarity: bool, text_col: str) -> HeldWords:
    """The most frequent words, as many as DEFAULT_BROADCAST_BYTES hold with their vectors, HELD_WORDS at most."""
    most = min(HELD_WORDS, DEFAULT_BROADCAST_BYTES // (8 * dim + 64))
    hot = frequent_keys(word_frequencies(df, F.lower(F.col(text_col))), "token", most)
    padded = F.slice(F.concat(F.coalesce(F.flatten(F.transform("_blocks", lambda b: F.coalesce(b, F.array().cast("array<double>")))),
                                         F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), dim)), 1, dim)
    vector = F.transform(padded, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("_v")
    own = table.join(F.broadcast(hot), "token").select("token", vector, (F.col("polarity") if polarity else F.lit(None).cast("double")).alias("_p"))
    found = own.toArrow().combine_chunks()
    places = {t: -1 for t in hot.toArrow().column("token").to_pylist()}
    tokens = found.column("token").to_pylist()
    at = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    places.update(at)
    held = HeldWords(places, *(np.zeros(shape, kind) for shape, kind in (((len(at), dim), float), (len(at), np.int64), (len(at), float), (len(at), np.int64))))
    if tokens:
        rows, p = np.array([at[t] for t in tokens]), found.column("_p").combine_chunks()
        np.add.at(held.vectors, rows, found.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        np.add.at(held.rows, rows, 1)
        np.add.at(held.polarity, rows, p.fill_null(0.0).to_numpy(zero_copy_only=False))
        np.add.at(held.hits, rows, p.is_valid().to_numpy(zero_copy_only=False).astype(np.int64))
    return held


def _near_sums(df: DataFrame, held: HeldWords, dim: int, text_col: str, id_col: str) -> DataFrame:
    """(id, text key, _w) of each row: the sums of its frequent words and the counts of its other words."""
    sent = df.sparkSession.sparkContext.broadcast(held)
    word = pa.struct([("token", pa.string()), ("_c", pa.int64())])
    kinds = pa.struct([("n", pa.int64()), ("p", pa.float64()), ("hits", pa.int64()), ("v", pa.list_(pa.float64())), ("far", pa.list_(word))])

    @F.arrow_udf("struct<n:bigint,p:double,hits:bigint,v:array<double>,far:array<struct<token:string,_c:bigint>>>")
    def summed(texts: pa.Array) -> pa.Array:
        own, out = sent.value, []
        for words in words_of(texts):
            far, at, counts, n, v = [], [], [], 0, np.zeros(dim)
            for t, c in Counter(words or ()).items():
                place = own.places.get(t)
                if place is None:
                    far.append({"token": t, "_c": c})
                elif place < 0:
                    n += c
                else:
                    at.append(place)
                    counts.append(c)
            places, c = np.array(at, np.int64), np.array(counts, np.int64)
            for a in range(0, len(at), NEAR_ROWS):
                v += c[a: a + NEAR_ROWS] @ own.vectors[places[a: a + NEAR_ROWS]]
            out.append({"n": n + int(c @ own.rows[places]), "p": float(c @ own.polarity[places]), "hits": int(c @ own.hits[places]), "v": v, "far": far})
        return pa.array(out, kinds)
    return df.select(id_col, *text_key(F.col(text_col)), summed(F.lower(F.col(text_col))).alias("_w"))


def _far_sums(pairs: DataFrame, table: DataFrame, dim: int, polarity: bool, keys: list[str], groups: int) -> DataFrame:
    """Block sums of counted words (keys, token, _c) that meet the table in a shuffle.

    A word's vector goes once to each of ``groups`` groups of texts, with the texts of the group that
    have it, and is added up there: neither vectors by text and word nor sums by text and task are moved."""
    lists = pairs.withColumn("_g", F.pmod("_h1", F.lit(groups))).repartition("token")
    lists = lists.groupBy("token", "_g").agg(F.collect_list(F.struct(*keys, "_c")).alias("_l"))
    met = lists.join(table, "token", "left").drop("token").repartition(groups, "_g")
    rows = met.select("_g", F.explode("_l").alias("_l"), "_blocks", *(["polarity"] if polarity else []))
    # Groups lie in a partition each, and so do the sums of a text.
    return _block_sums(rows.select("_g", "_l.*", "_blocks", *(["polarity"] if polarity else [])), dim, polarity, ["_g", *keys]).drop("_g")


def _layered_blocks(df: DataFrame, table: DataFrame, dim: int, polarity: bool, text_col: str, id_col: str) -> DataFrame:
    """Block sums of every text for a table beyond a broadcast.

    Frequent words are added up where the text lies. The others meet the table in up to FAR_ROUNDS
    rounds, each of a part of the words, so that a round's files are gone when the next one begins."""
    keys, once = [id_col, *TEXT_KEY], ["_n", *(["_p", "_hits"] if polarity else [])]
    table = _narrowest(table)
    # Equal rows have equal sums; they are made one by the text's key, without the text.
    near = cut_lineage(_near_sums(df, _held_words(df, table, dim, polarity, text_col), dim, text_col, id_col))
    n_far = near.agg(F.sum(F.size("_w.far"))).first()[0] or 0
    v = F.col("_w.v")
    blocks = F.array(*[F.slice(v, a + 1, min(BLOCK_DIMS, dim - a)) for a in range(0, dim, BLOCK_DIMS)])
    parts = near.select(*keys, F.posexplode(blocks).alias("_b", "_v"), F.col("_w.n").alias("_n"), F.col("_w.p").alias("_p"), F.col("_w.hits").alias("_hits"))
    parts = parts.select(*keys, "_b", "_v", *[F.when(F.col("_b") == 0, F.col(c)).alias(c) for c in once])
    pairs = near.select(*keys, F.explode("_w.far").alias("_f")).select(*keys, "_f.token", "_f._c")
    rounds = int(min(FAR_ROUNDS, -(-n_far // FAR_PAIRS)))
    groups = int(max(df.sparkSession.sparkContext.defaultParallelism, n_far // GROUP_PAIRS))
    for r in range(rounds):
        part = F.pmod(F.xxhash64("token"), F.lit(rounds)) == r
        far = _far_sums(pairs.where(part), table.where(part), dim, polarity, keys, groups)
        parts = parts.unionByName(cut_lineage(far.select(*keys, "_b", "_v", *once)))
    sums = [F.coalesce(F.sum(F.get("_v", F.lit(j))), F.lit(0.0)) for j in range(min(dim, BLOCK_DIMS))]
    # A text has a row a block and part: moved once, by its key.
    return parts.repartition(*keys).groupBy(*keys, "_b").agg(F.array(*sums).alias("_v"), *[F.sum(c).alias(c) for c in once])


def pooled_word_vectors(df: DataFrame, word_vectors: DataFrame, dim: int, text_col: str = TEXT,
                        id_col: str = COMMENT_ID, out: str = "pooled", strategy: str = "auto") -> DataFrame:
    """G2 alone."""
    return token_lookup_features(df, word_vectors=word_vectors, dim=dim, text_col=text_col, id_col=id_col,
                                 pooled_out=out, strategy=strategy)


def lexicon_polarity(df: DataFrame, lexicon: DataFrame, text_col: str = TEXT, id_col: str = COMMENT_ID,
                     out: str = "polarity", strategy: str = "auto") -> DataFrame:
    """G5 alone."""
    return token_lookup_features(df, lexicon=lexicon, text_col=text_col, id_col=id_col, polarity_out=out,
                                 strategy=strategy)


def _unk_id(vocab: DataFrame) -> int:
    r = vocab.where(F.col("token") == UNK).select("id").limit(1).collect()
    if not r:
        raise ValueError(f"vocabulary has no {UNK} entry")
    return int(r[0][0])


def window_token_rows(df: DataFrame, window: int, hop: int, max_windows: int | None,
                      text_col: str = TEXT, id_col: str = COMMENT_ID) -> DataFrame:
    """``(id, window_idx, pos, token)``: a text's tokens are taken out once, each goes to the windows that hold it."""
    check_window(window, hop)
    rows = df.select(id_col, F.posexplode(tokens(F.col(text_col))).alias("_at", "token"))
    first = F.greatest(F.floor((F.col("_at") - (window - 1) + (hop - 1)) / F.lit(hop)), F.lit(0)).cast("int")
    last = F.floor(F.col("_at") / F.lit(hop)).cast("int")
    if max_windows is not None:
        last = F.least(last, F.lit(max_windows - 1))
    held = F.when(first <= last, F.sequence(first, last, F.lit(1)))  # a hop wider than the window leaves tokens out
    rows = rows.select(id_col, "_at", "token", F.explode(held).alias("window_idx"))
    return rows.select(id_col, "window_idx", (F.col("_at") - F.col("window_idx") * hop).alias("pos"), "token")


def vocab_encode(df: DataFrame, vocab: DataFrame, window: int, hop: int, max_windows: int | None = None,
                 text_col: str = TEXT, id_col: str = COMMENT_ID, strategy: str = "auto") -> DataFrame:
    """``(id, window_idx, pos, token, word_id)``; unknown tokens get ``<UNK>``'s id.
    Lookup is exact (case-sensitive), as for the style model."""
    unk = _unk_id(vocab)
    rows = window_token_rows(df, window, hop, max_windows, text_col, id_col)
    ids = vocab.select("token", F.col("id").alias("word_id"))
    if strategy == "auto":
        strategy = "broadcast" if fits_broadcast(ids) else "layered"
    if strategy == "layered":
        hit = layered_join(rows, ids, "token", word_frequencies(df, F.col(text_col)))
    else:
        hit = lookup_join(rows, ids, "token", "left", strategy=strategy, salt_cols=[id_col, "window_idx", "pos"])
    return hit.select(id_col, "window_idx", "pos", "token",
                      F.coalesce(F.col("word_id"), F.lit(unk)).cast("int").alias("word_id"))


def window_lengths(df: DataFrame, window: int, hop: int, max_windows: int | None = None,
                   text_col: str = TEXT, id_col: str = COMMENT_ID) -> DataFrame:
    """Tokens per window (N_w) with the number of windows of its text (N_s). Both follow
    from the number of tokens."""
    check_window(window, hop)
    sized = df.select(id_col, F.size(tokens(F.col(text_col))).alias("_n"))
    n = F.ceil(F.col("_n") / F.lit(hop)).cast("int")
    if max_windows is not None:
        n = F.when(n > max_windows, F.lit(max_windows)).otherwise(n)  # null for a null text
    rows = sized.select(id_col, "_n", n.alias("n_windows"))
    held = F.when(F.col("n_windows") > 0, F.sequence(F.lit(0), F.col("n_windows") - 1))
    rows = rows.select(id_col, "_n", "n_windows", F.explode(held).alias("window_idx"))
    return rows.select(id_col, "n_windows", "window_idx",
                       F.least(F.lit(window), F.col("_n") - F.col("window_idx") * hop).cast("int").alias("n_words"))


class Alphabet:
    """Code points to ids: a character table of one row a character (Unicode bounds them)."""

    def __init__(self, char_vocab: DataFrame):
        self.unk = _unk_id(char_vocab)
        one = char_vocab.where((F.char_length("token") == 1) & F.col("id").isNotNull()).groupBy("token").agg(F.min("id").alias("id"))
        self.ids = {ord(r["token"]): int(r["id"]) for r in one.collect()}

    def table(self) -> np.ndarray:
        """Ids by code point; beyond its end is no known character."""
        out = np.full(max(self.ids, default=0) + 2, self.unk, np.int32)
        for c, i in self.ids.items():
            out[c] = i
        return out


def char_ids(words: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all characters of the words, one after the other, and the words' lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    return table[np.minimum(points, len(table) - 1)], np.fromiter(map(len, words), np.int64, len(words))


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def char_encode(df: DataFrame, char_vocab: DataFrame, window: int, hop: int, max_windows: int | None = None,
                max_chars: int | None = None, text_col: str = TEXT, id_col: str = COMMENT_ID) -> DataFrame:
    """``(id, window_idx, pos, char_ids array<int>)``.

    The character table goes to the tasks whole (Unicode bounds it), so tokens are encoded
    where they are, in Arrow batches, and none is shuffled.
    ``max_windows`` and ``max_chars`` are the model's input shape, off by default."""
    alphabet = Alphabet(char_vocab)
    rows = window_token_rows(df, window, hop, max_windows, text_col, id_col)

    def encode(batches):
        table = alphabet.table()
        for batch in batches:
            words = [w.decode("utf-8", "replace")[:max_chars] for w in batch.column("token").cast(pa.binary()).to_pylist()]
            ids, sizes = char_ids(words, table)
            lists = pa.ListArray.from_arrays(pa.array(offsets(sizes)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, "window_idx", "pos")), lists],
                                             names=[id_col, "window_idx", "pos", "char_ids"])
    kept = rows.select(id_col, "window_idx", "pos", "token")
    schema = T.StructType([*kept.schema.fields[:3], T.StructField("char_ids", T.ArrayType(T.IntegerType()))])
    return kept.mapInArrow(encode, schema)
