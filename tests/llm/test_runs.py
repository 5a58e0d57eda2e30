import collections
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF01
from fixtures import hostile, prose, words

from glosa.llm.queries import op13_periodic_runs
from glosa.llm.runs import SuffixTree, lyndon_ends, periodic_runs, runs_of, stretches


def brute(w, min_words=6, min_exponent=4):
    """Every period, every stretch of words that equal those a period on."""
    out, n = set(), len(w)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            if j > i and length >= max(min_words, min_exponent * q) and not any(
                    all(w[k] == w[k + d] for k in range(start, start + length - d)) for d in range(1, q)):
                out.add((start, length, q))
            i = max(j, i + 1)
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3).flatmap(lambda k: st.lists(st.integers(1, k), min_size=1, max_size=40)))
def test_runs_of_small_alphabets(w):
    assert runs_of(w, 3, 2).tolist() == [list(r) for r in brute(w, 3, 2)]
    assert runs_of(w, 6, 4).tolist() == [list(r) for r in brute(w)]
    found = [(a + s, n, p) for a, b in stretches(np.array(w), np.zeros(len(w), int), 6, 4)
             for s, n, p in runs_of(w[a:b], 6, 4).tolist()]
    assert found == brute(w)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_extensions_and_lyndon_words(w):
    n, tree = len(w), SuffixTree(w)
    order = tree.euler()
    assert order.tolist() == sorted(range(n + 1), key=lambda i: w[i:])
    down = tree.descending()
    assert down.tolist() == sorted(range(n + 1), key=lambda i: [-x for x in w[i:]])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    i, j = i[i != j], j[i != j]
    common = [next((k for k in range(n) if a + k >= n or b + k >= n or w[a + k] != w[b + k]), n) for a, b in zip(i, j)]
    assert tree.extension(i, j).tolist() == common
    for of, sign in ((order, 1), (down, -1)):
        v = [sign * x for x in w]
        for a, e in enumerate(lyndon_ends(of, n).tolist()):
            lyndon = [k for k in range(a + 1, n + 1) if all(v[a:k] < v[m:k] for m in range(a + 1, k))]
            assert e == max(lyndon)


def altered(doc_id, text):
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc_id, w):
    runs = brute(w)
    drop = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def quick(w):
    """``brute`` with numpy for each period, for long texts."""
    number = {}
    v = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    out, n = set(), len(v)
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([0], (v[q:] == v[:-q]).astype(np.int8), [0]))
        turns = np.flatnonzero(np.diff(same))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if b - a + q >= max(6, 4 * q) and not any((v[a:b + q - d] == v[a + d:b + q]).all() for d in range(1, q)):
                out.add((a, b - a + q, q))
    return sorted(out)


def test_query_matches_brute_force(spark, monkeypatch):
    """The whole query over the whole table."""
    monkeypatch.setitem(globals(), "brute", quick)
    t = pq.read_table(f"{SF01}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = collections.Counter(digest(r["doc_id"], altered(r["doc_id"], r["text"])) for r in t)
    out = op13_periodic_runs(spark, SF01)
    assert collections.Counter(map(tuple, out.collect())) == want
    assert sum(r[1] > 0 for r in want) > 50
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_hostile_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing names, all one word, nested runs, runs at both ends."""
    texts = ["a " * 5, "a " * 6, "b " + "a b " * 4 + "c", "x x x x x y " * 4, "a\x0bb\ta\nb\r\na b a b", "ä é " * 5, "a b a " * 9,
             "p q r " * 7 + "p q", "one " + "p q r " * 7, "l i n e\n" * 5000]
    more = spark.createDataFrame([(200 + i, t, "en", "s", 0) for i, t in enumerate(texts)], hostile(spark).schema)
    docs = hostile(spark).unionByName(more).withColumn("row", F.lit(1)).withColumn("runs", F.lit("clash"))
    out = periodic_runs(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        w = words(r.row.text)
        runs = [tuple(x) for x in r.runs]
        assert r.n_words == len(w) and runs == quick(w)
        drop = {k for s, n, p in runs for k in range(s + p, s + n)}
        assert r.collapsed == " ".join(x for k, x in enumerate(w) if k not in drop)
        assert (r.best is None) == (not runs)
    assert {r.row.doc_id: len(r.runs) for r in out if (r.row.doc_id or 0) >= 200} == {
        200: 0, 201: 1, 202: 1, 203: 1, 204: 1, 205: 1, 206: 1, 207: 1, 208: 1, 209: 1}
    assert periodic_runs(docs.limit(0)).isEmpty()


def test_long_text_with_long_runs(spark):
    """150,000 words that repeat a passage of 30,000, and a plain text of as many."""
    passage = prose(11, 30_000)
    docs = spark.createDataFrame([(1, " ".join([passage] * 5)), (2, " ".join(f"u{i}" for i in range(150_000)))], "id long, text string")
    rows = {r.row.id: r for r in periodic_runs(docs).collect()}
    period = rows[1].best.period
    w = words(passage)
    assert all(w[i] == w[i + period] for i in range(len(w) - period)) and rows[1].best.length == 150_000
    assert rows[2].best is None and rows[2].collapsed == docs.where("id = 2").first().text
