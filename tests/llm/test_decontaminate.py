import collections
import hashlib
import random
import re
import resource

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SF01
from fixtures import DOCS, LOWER, hostile, prose

from glosa.llm import decontaminate
from glosa.llm.decontaminate import Matcher, contaminated, words_of
from glosa.llm.queries import QUERIES

BENCH = "item_id long, text string"
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=10):
    strings = []
    for item, text in items:
        w = TOKEN.findall((text or "").translate(LOWER))
        m = min(window, len(w))
        strings += [(tuple(w[i:i + m]), item) for i in range(len(w) - m + 1 if m else 0)]
    by = collections.defaultdict(set)
    for s, item in strings:
        by[s].add(item)
    out = []
    for doc, text in docs:
        w = TOKEN.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for m in {len(s) for s in by}:
            for i in range(len(w) - m + 1):
                if (s := tuple(w[i:i + m])) in by:
                    hit |= set(range(i, i + m))
                    found |= by[s] - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return collections.Counter(out)


def digest(out):
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    rows = out.select("row.doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(listed, 256).alias("d"),
                      "contaminated").collect()
    return collections.Counter(tuple(r) for r in rows)


def test_query_matches_brute_force(spark):
    read = lambda t, c: [tuple(r.values()) for r in pq.read_table(f"{SF01}/{t}.parquet", columns=c).to_pylist()]
    rows = QUERIES["op10_wu_manber"](spark, SF01).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    want = brute(read("documents", ["doc_id", "text"]), read("benchmark", ["item_id", "text"]))
    assert got == want and any(k[5] for k in want)


def items_for_hostile():
    return [(1, prose(1, 30)), (1, prose(3, 15)), (2, "One, TWO!"), (3, "spam"), (None, prose(2, 12)), (4, None), (5, ""),
            (6, " ... "), (7, prose(3, 20_000)), (7, "b c d"), (8, "éİ"), (9, "one two"), (2, "One, TWO!")]


def test_hostile_rows_in_one_and_many_blocks(spark):
    docs = hostile(spark).withColumn("items", F.lit("clash")).withColumn("row", F.lit(1))
    bench = spark.createDataFrame(items_for_hostile(), BENCH)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items_for_hostile())
    assert digest(contaminated(docs, bench)) == want
    assert digest(contaminated(docs, bench, block_bytes=20_000)) == want


def test_empty_tables(spark):
    empty, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], BENCH)
    assert contaminated(empty, spark.createDataFrame(items_for_hostile(), BENCH)).collect() == []
    assert not any(r.contaminated for r in contaminated(hostile(spark), bench).collect())


def test_matcher_finds_overlapping_occurrences_and_skips():
    rng = random.Random(3)
    for _ in range(200):
        m = rng.randint(1, 5)
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))] for _ in range(3)]
        strings = {tuple(rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(m)): k for k in range(6)}
        matcher = Matcher([(k, b" ".join(s)) for s, k in strings.items()], 10)
        got = sorted((k, a, b, *of) for k, t in enumerate(texts) for a, b, of in matcher.search(t))
        want = sorted((k, i, i + m, strings[tuple(t[i:i + m])]) for k, t in enumerate(texts) for i in range(len(t) - m + 1)
                      if tuple(t[i:i + m]) in strings)
        assert got == want

    class Counted(list):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += 1
            return super().__getitem__(at)
    list(Matcher([(1, b" ".join(b"%d" % i for i in range(10)))], 10).search(Counted([b"x"] * 9000)))
    assert Counted.reads <= 1001


def test_a_full_block_is_small_and_quick():
    """A block of 16 MB: under 1 GB, and documents are searched at speed."""
    rng = random.Random(5)
    vocabulary = [b"w%d" % i for i in range(60_000)]
    items, size = [], 0
    while size < 16_000_000:
        items.append((len(items), b" ".join(rng.choices(vocabulary, k=20_000))))
        size += len(items[-1][1])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    matcher = Matcher(items, 10)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB
    planted = words_of(items[77][1])[500:520]
    texts = [rng.choices(vocabulary, k=500) for _ in range(200)]
    texts[9][100:100] = planted
    found = [(k, tuple(of)) for k, t in enumerate(texts) for _, _, of in matcher.search(t)]
    assert set(found) == {(9, (77,))} and len(found) == 11


def test_matchers_are_kept_per_process(monkeypatch):
    made = []
    monkeypatch.setattr(decontaminate, "Matcher", lambda items, window: made.append(items) or object())
    monkeypatch.setattr(decontaminate, "_MATCHERS", {})

    class Held:
        def __init__(self, key):
            self.value = (key, [])
    for key in "aabbab":
        decontaminate._matcher(Held(key), 10)
    assert len(made) == 2
    decontaminate._matcher(Held("c"), 10)
    assert len(made) == 3 and len(decontaminate._MATCHERS) == decontaminate.MATCHERS_KEPT
