import collections

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fixtures import DOCS, LOWER, hostile, prose, words

from glosa.llm import minhash
from glosa.llm.minhash import bands_for, components, near_duplicates, superminhash


def brute(rows, k, num, den=100):
    """Multiset of (id, n_shingles, component, kept) by comparing all sets that share a shingle."""
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    index, shared = collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    for at in index.values():
        for a in range(len(at)):
            for b in range(a + 1, len(at)):
                shared[at[a], at[b]] += 1
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return collections.Counter(
        (doc, len(sets[i]), c := (least.get(root(i)) if sets[i] else doc), doc == c) for i, (doc, _) in enumerate(rows))


def got(df):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_matches_brute_force_on_documents(spark, k, num):
    t = pq.read_table(f"{SF01}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    assert got(near_duplicates(docs, shingle=k, num=num)) == brute([(r["doc_id"], r["text"]) for r in t], k, num)


def test_hostile_rows(spark):
    docs = hostile(spark).withColumn("kept", F.lit("clash")).withColumn("set_key", F.lit(1))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_duplicates(docs, shingle=3, num=85)) == brute(rows, 3, 85)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_large_group_of_near_copies(spark):
    rows = [(i, prose(9, 200) + " " + prose(100 + i, 4), "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, prose(200 + i, 12) + " " + prose(11, 30), "en", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    assert got(near_duplicates(docs, shingle=3, num=85)) == brute([r[:2] for r in rows], 3, 85)


def test_large_buckets_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SALT_ROWS", 16)
    test_large_group_of_near_copies(spark)


def test_look_alike_pages_that_do_not_link(spark):
    # One template; a part of each page's own just too large for a link (98 of 128 shingles in common).
    rows = [(i, prose(9, 100) + " " + prose(100 + i, 15), "en", "s", 0) for i in range(5000)]
    rows += [(9000 + i, prose(9, 100) + " " + prose(77, 3) + " " + prose(20000 + i, 1), "en", "s", 0) for i in range(40)]
    out = near_duplicates(spark.createDataFrame(rows, DOCS), shingle=3, num=85).collect()
    assert len(out) == 5040
    assert all(r.kept == (r.doc_id <= 9000) for r in out)
    assert {r.component_id for r in out if r.doc_id >= 9000} == {9000}


def test_blends_of_common_passages(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SALT_ROWS", 64)
    rng = np.random.default_rng(3)
    pool = [prose(300 + i, 6) for i in range(40)]
    # No passage is rare; some blends link, most do not.
    rows = [(i, " ".join(pool[j] for j in sorted(rng.choice(40, 36, replace=False))), "en", "s", 0) for i in range(250)]
    docs = spark.createDataFrame(rows, DOCS)
    assert got(near_duplicates(docs, shingle=3, num=85)) == brute([r[:2] for r in rows], 3, 85)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    sig = superminhash([pool[:1000], pool[500:], pool[:1], pool[:40]], 180)
    assert abs((sig[0] == sig[1]).mean() - 500 / 1500) < 0.12
    # One element fills each slot at its own step; a signature does not depend on the other sets.
    assert sorted(sig[2] >> np.uint64(32)) == list(range(180))
    assert (superminhash([pool[:40]], 180)[0] == sig[3]).all()


def test_band_count_keeps_the_miss_probability():
    n = bands_for(0.85, 6, 1e-6)
    assert (1 - 0.85**6) ** n <= 1e-6 < (1 - 0.85**6) ** (n - 1)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 139)] + [(500, 501)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    out = {r.node: r.component for r in components(df).collect()}
    assert out == {i: 0 for i in [*range(1, 51), *range(100, 140)]} | {501: 500}
