"""Operator 7: token ids in files of directly addressable codes.

Documents are put into ascending id order over range partitions. Each task
encodes its documents with a tokenizer and writes shards, binary files that
hold whole documents and about ``shard_tokens`` ids. A shard stores its ids as
directly addressable codes: an id is cut into chunks of 8 bits; level 0 has the
lowest chunk of every id, level 1 the second of those ids that have one, and so
on; a bitmap says for each chunk whether another follows, and a rank directory
(set bits before each 512-bit block) leads from a chunk to its successor. So
any id is read by its position without decoding others.

File: b"DACT", then little-endian int64: version, partition, number in the
partition, documents, ids, levels; for each document its id (int64), a null
flag (uint8) and its number of ids (int64); for each level its number of chunks
(int64), the chunks (uint8), the bitmap (uint64 words) and the directory
(int64).

Shards are written next to their final place and renamed, so a task that runs
again leaves the same files. Token counts by partition, a row each, give every
shard its place in the whole.

A null text is empty: it has the end id alone. Ids must be integers; null ids
come last, repeated ones one after the other by text. Extra columns are not
read.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosa.llm.common import scratch, slices, stored

MAGIC, VERSION, CHUNK_BITS, BLOCK = b"DACT", 1, 8, 512
SLICE_BYTES = 4_000_000
MEMO_WORDS = 400_000


# ---- codes ----------------------------------------------------------------

def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap words, directory) of each level."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest >> np.uint32(CHUNK_BITS)
        follows = more > 0
        bits = np.packbits(follows, bitorder="little")
        words = np.zeros(-(-len(bits) // 64) * 8, np.uint64)
        words.view(np.uint8)[: len(bits)] = bits
        ones = np.bitwise_count(words.reshape(-1, BLOCK // 64)).sum(axis=1, dtype=np.int64)
        levels.append(((rest & np.uint32(255)).astype(np.uint8), words, np.cumsum(ones) - ones))
        if not follows.any():
            return levels
        rest = more[follows]


def decode_levels(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The ids at positions lo to hi."""
    hi = len(levels[0][0]) if hi is None else hi
    out = levels[0][0][lo:hi].astype(np.uint32)
    at = np.arange(len(out))
    for k in range(1, len(levels)):
        _, words, _ = levels[k - 1]
        first = lo // 8
        bits = np.unpackbits(words.view(np.uint8)[first: hi // 8 + 1], bitorder="little")[lo - 8 * first: hi - 8 * first]
        follows = np.flatnonzero(bits)
        start = _rank(levels[k - 1], lo)
        lo, hi = start, start + len(follows)
        at = at[follows]
        out[at] |= levels[k][0][lo:hi].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
    return out


def _rank(level: tuple[np.ndarray, np.ndarray, np.ndarray], i: int) -> int:
    """Set bits before bit i."""
    _, words, directory = level
    block, word = i // BLOCK, i // 64
    if block >= len(directory):
        return int(directory[-1] + np.bitwise_count(words[(len(directory) - 1) * BLOCK // 64:]).sum()) if len(directory) else 0
    whole = np.bitwise_count(words[block * BLOCK // 64: word]).sum(dtype=np.int64)
    return int(directory[block] + whole) + (int(words[word]) & ((1 << (i % 64)) - 1)).bit_count()


def access(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], i: int) -> int:
    """The id at position i: a chunk, a bit and a rank for each level."""
    out, k = 0, 0
    while True:
        chunks, words, _ = levels[k]
        out |= int(chunks[i]) << (CHUNK_BITS * k)
        if not (int(words[i // 64]) >> (i % 64)) & 1:
            return out
        i, k = _rank(levels[k], i), k + 1


def pack(partition: int, number: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    parts = [MAGIC, struct.pack("<6q", VERSION, partition, number, len(doc_ids), len(ids), len(levels)),
             np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
             np.array([i is None for i in doc_ids], np.uint8).tobytes(), lengths.astype("<i8").tobytes()]
    for chunks, words, directory in levels:
        parts += [struct.pack("<q", len(chunks)), chunks.tobytes(), words.tobytes(), directory.astype("<i8").tobytes()]
    return b"".join(parts)


class Shard:
    """A shard in memory; arrays are views of its bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        version, self.partition, self.number, docs, self.n_ids, n_levels = struct.unpack_from("<6q", data, 4)
        if version != VERSION:
            raise ValueError(f"token shard of version {version}")
        at = 52
        ids, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
        null, at = np.frombuffer(data, np.uint8, docs, at), at + docs
        self.lengths, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
        self.doc_ids = [None if n else int(i) for i, n in zip(ids, null, strict=True)]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<q", data, at)
            at += 8
            chunks, at = np.frombuffer(data, np.uint8, n, at), at + n
            blocks = -(-(-(-n // 8)) // 64)
            words, at = np.frombuffer(data, "<u8", blocks * 8, at), at + 64 * blocks
            directory, at = np.frombuffer(data, "<i8", blocks, at), at + 8 * blocks
            self.levels.append((chunks, words, directory))

    def __getitem__(self, i: int) -> int:
        return access(self.levels, i)

    def document(self, k: int) -> np.ndarray:
        return decode_levels(self.levels, int(self.starts[k]), int(self.starts[k] + self.lengths[k]))


# ---- tokenizer --------------------------------------------------------------

class Encoder:
    """Byte-level BPE ids of texts as little-endian uint32 bytes.

    The tokenizer cuts texts before each single space, whatever stands around
    it, so a word after such a space has the same ids everywhere: ids of words
    are kept, and the words that are new are encoded together, each behind its
    space. Texts in which white space meets white space, or that begin or end
    with it, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        first = [(self.tokenizer.id_to_token(i) or "").startswith("Ġ")
                 for i in range(self.tokenizer.get_vocab_size())]
        self.opens = np.array(first)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: list[str]) -> None:
        groups = [new[k: k + 100] for k in range(0, len(new), 100)]
        texts = [" " + " ".join(some) for some in groups]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(some):
                raw, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                self.young.update((w, raw[a:b]) for w, a, b in zip(some, at, at[1:]))
            else:
                self.young.update((w, self._ids(" " + w).tobytes()) for w in some)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > MEMO_WORDS:
            self.young, self.old = {}, self.young
        get, old, young = self.young.get, self.old.get, self.young
        held, gaps, new = [], [], {}
        for text in texts:
            words = text.split(" ")
            if len(words) == 1 or not words[0] or words[0][-1].isspace():
                held.append(None)
                continue
            head, words[0] = words[0], ""
            ids = [*map(get, words)]
            ids[0] = b""
            missing, i = [], 0
            while True:
                try:
                    i = ids.index(None, i)
                except ValueError:
                    break
                w = words[i]
                known = old(w)
                if known is not None:
                    ids[i] = young[w] = known
                elif w in new:
                    missing.append((i, w))
                elif not w or w[0].isspace() or w[-1].isspace():
                    ids = None
                    break
                else:
                    new[w] = None
                    missing.append((i, w))
                i += 1
            held.append(ids)
            if ids is not None:
                ids[0] = self._head(head)
                gaps.append((ids, missing))
        self._learn([*new])
        for ids, missing in gaps:
            for i, w in missing:
                ids[i] = young[w]
        return [b"".join(ids) if ids is not None else self._ids(text).tobytes() if text else b""
                for text, ids in zip(texts, held, strict=True)]

    def _head(self, word: str) -> bytes:
        """Ids of a text's first word, which stands behind no space."""
        ids = self.heads.get(word)
        if ids is None:
            if len(self.heads) > MEMO_WORDS // 10:
                self.heads.clear()
            ids = self.heads[word] = self._ids(word).tobytes()
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so the words it keeps serve all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- files --------------------------------------------------------------------

def _write_file(folder: str, name: str, data: bytes) -> None:
    system, base = fs.FileSystem.from_uri(folder)
    part = f"{base}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{base}/{name}")


def _writer(folder: str, tokenizer: str, end_id: int, shard_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        partition, number = TaskContext.get().partitionId(), itertools.count()
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        held: list[bytes] = []
        n_ids = 0

        def flush() -> pa.RecordBatch:
            k = next(number)
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            data = pack(partition, k, docs, lengths, np.frombuffer(b"".join(held), "<u4"))
            _write_file(folder, f"shard-{partition:06d}-{k:06d}.dac", data)
            return pa.RecordBatch.from_pylist([{"partition": partition, "number": k, "n_docs": len(docs), "n_ids": n_ids}],
                                              schema=pa.schema([(c, pa.int64()) for c in ("partition", "number", "n_docs", "n_ids")]))

        for part in slices(batches, "text", SLICE_BYTES):
            texts = [(t or b"").decode("utf-8", "replace") for t in part.column("text").to_pylist()]
            for doc, ids in zip(part.column("id").to_pylist(), encode(texts), strict=True):
                docs.append(doc)
                held.append(ids + end)
                n_ids += len(ids) // 4 + 1
                if n_ids >= shard_tokens:
                    yield flush()
                    docs, held, n_ids = [], [], 0
        if docs:
            yield flush()
    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 2, shard_tokens: int = 4_000_000) -> DataFrame:
    """Encode texts into shards under ``folder`` (a URI that all executors reach).

    Returns the shards: partition, number, n_docs, n_ids and ``first``, the ids
    of all shards before it.
    """
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text").asc()]
    docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = stored(docs.mapInArrow(_writer(folder, tokenizer, end_id, shard_tokens),
                                    "partition long, number long, n_docs long, n_ids long"), "shards")
    # A row for each partition in one task, then shards within their partitions.
    totals = shards.groupBy("partition").agg(F.sum("n_ids").alias("ids"))
    totals = totals.select("partition", F.coalesce(F.sum("ids").over(W.orderBy("partition").rowsBetween(*_BEFORE)),
                                                   F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("partition").orderBy("number").rowsBetween(*_BEFORE)), F.lit(0))
    return shards.withColumn("inside", inside).join(totals, "partition").select(
        "partition", "number", "n_docs", "n_ids", (F.col("base") + F.col("inside")).alias("first"))


_BEFORE = (W.unboundedPreceding, -1)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for value in part.column("content"):
            shard = Shard(value.as_buffer().to_pybytes())
            ids = decode_levels(shard.levels).astype("<u4")
            ends = (shard.starts + shard.lengths).tolist()
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(shard.starts.tolist(), ends, strict=True)]
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard.partition)), pa.array(np.full(n, shard.number)),
                 pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts), pa.array(shard.lengths.astype(np.int64)),
                 pa.array(sums, pa.int64())],
                names=["partition", "number", "id", "inside", "n_tokens", "ids_crc32"])


def read_documents(spark, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.dac").load(folder).select("content")
    rows = files.mapInArrow(_reader, "partition long, number long, id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(shards, ["partition", "number"]).select(
        F.col("id").alias("doc_id"), (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write a table's shards to a new folder under the shared one and read them back. An empty table gives no rows."""
    folder = scratch(docs.sparkSession, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    shards = write_shards(docs, folder, tokenizer, **options)
    return read_documents(docs.sparkSession, folder, shards)
