import collections

from pyspark.sql import functions as F

from conftest import SF01
from fixtures import DOCS, hostile, words

from glosa.llm.mixing import mix, mixed_documents, targets


def water_fill(sizes, weights=(1, 2, 3), limit=3):
    """Reshare the excess by weight until no target is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > limit * sizes[s]}
        if not over:
            return {s: float(limit * sizes[s]) if s in capped else share[s] for s in order}
        capped |= over


def check(docs, rows):
    sizes = collections.defaultdict(int)
    largest = collections.defaultdict(int)
    for r in docs.collect():
        n = len(words(r.text))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    want = water_fill(sizes)
    want_rows = collections.Counter((r.doc_id, len(words(r.text)), sizes[r.source]) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.size, r.source_size) for r in rows) == want_rows
    taken = collections.defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == r.copies * r["size"]
        assert any(abs(r.target - t) <= 1e-6 * max(1, t) for t in want.values())
    assert abs(sum(r.taken for r in rows) - sum(want.values())) <= sum(largest.values())


def test_targets_by_repeated_resharing(spark):
    for sizes in ({"a": 100, "b": 5, "c": 60, "d": 1, None: 30}, {"x": 10}, {"a": 0, "b": 0}, {"a": 0, "b": 7, "": 50}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df).collect()}
        want = water_fill(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = mix(docs).collect()
    check(docs, rows)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())
    assert rows and sorted(rows) == sorted(mix(docs.repartition(7)).collect())


def test_hostile_rows(spark):
    docs = hostile(spark).withColumn("size", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("row", F.lit(2))
    check(docs, mix(docs).collect())


def test_mixed_documents_follow_the_decisions(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").withColumn("copies", F.lit(None).cast("int"))
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    assert got == collections.Counter({r.doc_id: r.copies for r in mix(docs).collect() if r.copies})


def test_one_repeated_row_is_taken_in_part(spark):
    rows = [(1, "a b c d", "en", "s1", 0)] * 100 + [(2, "a b", "en", "s2", 0)] * 30
    out = mix(spark.createDataFrame(rows, DOCS)).collect()
    taken, target = collections.Counter(), {}
    for r in out:
        taken[r.doc_id] += r.taken
        target[r.doc_id] = r.target
    assert all(abs(taken[i] - target[i]) <= 2 for i in (1, 2))


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mix(empty).collect() == [] and mixed_documents(empty).collect() == []
