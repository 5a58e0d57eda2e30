import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF01
from fixtures import DOCS, hostile

from glosa.llm.queries import QUERIES
from glosa.llm.tokens import Encoder, Shard, access, decode_levels, encode_levels, pack, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows):
    """(doc, start, n, crc) by one call of the tokenizer for each text, in order."""
    t, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_matches_plain_encoding(spark):
    rows = pq.read_table(f"{SF01}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = plain(sorted((r["doc_id"], r["text"]) for r in rows))
    got = sorted(tuple(r) for r in QUERIES["op7_direct_codes"](spark, SF01).collect())
    assert got == want


def test_hostile_rows_in_small_shards(spark):
    docs = hostile(spark).withColumn("partition", F.lit("clash"))
    got = [tuple(r) for r in token_files(docs, PATH, shard_tokens=500).collect()]
    plain_of = {}
    for doc, _, n, crc in plain([(r.doc_id, r.text) for r in docs.collect()]):
        plain_of.setdefault(doc, []).append((n, crc))
    mine = {}
    for doc, _, n, crc in got:
        mine.setdefault(doc, []).append((n, crc))
    assert {d: sorted(v) for d, v in mine.items()} == {d: sorted(v) for d, v in plain_of.items()}
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == [sum(x[2] for x in by_start[:i]) for i in range(len(by_start))]
    ids = [r[0] for r in by_start]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))


def test_empty_table(spark):
    assert token_files(spark.createDataFrame([], DOCS), PATH).collect() == []


@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**32 - 1), st.integers(0, 70_000)), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_codes_round_trip_and_random_access(ids):
    ids = np.array(ids, np.uint32)
    shard = Shard(pack(3, 1, [5, None], np.array([len(ids) // 2, len(ids) - len(ids) // 2]), ids))
    assert shard.doc_ids == [5, None] and (decode_levels(shard.levels) == ids).all()
    assert (np.concatenate([shard.document(0), shard.document(1)]) == ids).all()
    for i in random.Random(1).sample(range(len(ids)), min(20, len(ids))):
        assert shard[i] == access(encode_levels(ids), i) == ids[i]


PIECES = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "word", "It's", "'ll", "9", "12x", "é", "日本", "́", "!",
          "...", "<|endoftext|>", "😀", "​", "Zz", "\r\n", "´"]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_tokenizer(texts):
    mine, t = _ENCODER, _ENCODER.tokenizer
    for text, ids in zip(texts, mine(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


_ENCODER = Encoder(PATH)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        Shard(b"PK\x03\x04" + bytes(60))
