import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import glosa.llm.hard_negatives as op
from glosa.llm.hard_negatives import Lists, hard_negatives

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                     T.StructField("label", T.IntegerType()), T.StructField("key", T.StringType()),
                     T.StructField("vector", T.StringType())])


def expected(rows, of=100):
    """Every anchor against every row."""
    usable = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label, *_ in rows if i is not None and label is not None
              and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for a, (anchor, label, v) in enumerate(usable):
        if anchor % of:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, k, other) for k, (i, other, w) in enumerate(usable) if k != a]
        same = sorted((s, i) for s, i, _, other in scored if other == label)[:5]
        for s, positive in same:
            window = sorted((t, i) for t, i, _, other in scored if other != label and 80 * s >= 100 * t >= 100 * s)[:5]
            out.update((anchor, positive, rank, i, -s, -t) for rank, (t, i) in enumerate(window, 1))
    return out


def got(spark, rows, of=100, parts=3):
    df = spark.createDataFrame(rows, ROWS).repartition(parts)
    return collections.Counter(map(tuple, hard_negatives(df, F.col("vec_id") % of == 0).collect()))


def random_rows(n, dim=8, seed=1, spread=0.5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dim))
    return [(i, [float(x) for x in centres[i % 4] + spread * r.normal(size=dim)], int(r.integers(4)), "clash", None) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.5, 3.0])
def test_against_all_scores(spark, monkeypatch, spread):
    monkeypatch.setattr(op, "BLOCK_VALUES", 500)  # several blocks a task
    monkeypatch.setattr(op, "GROUP_BYTES", 1000)  # several groups of anchors
    rows = random_rows(400, spread=spread)
    assert got(spark, rows, 40) == expected(rows, 40)


def test_hostile_rows(spark):
    """Nulls, non-finite and huge components, uneven and empty vectors, zeros, copies, repeated and negative ids, ties."""
    rows = random_rows(120, dim=3)
    one = [1.0, 0.5, -0.25]
    rows += [(200 + i, one, i % 2, None, "v") for i in range(40)]  # ties
    rows += [(300, one, 0, None, None)] * 3 + [(100, [0.0, 0.0, 0.0], 1, None, None), (400, [], 1, None, None),
             (500, [2.0], 1, None, None), (501, [1.0, 1.0, 1.0, 4.0], 0, None, None), (-100, [-1.0, 2.0, 1.0], 0, None, None),
             (None, one, 0, None, None), (600, None, 0, None, None), (601, one, None, None, None), (700, [1.0, None, 2.0], 0, None, None),
             (800, [1.0, math.nan, 2.0], 0, None, None), (900, [math.inf, 1.0, 2.0], 0, None, None)]
    assert got(spark, rows) == expected(rows)
    assert got(spark, rows, parts=1) == expected(rows)
    big = [(100 * i, [3e5 * (i + 1), 1.0 + i, -2e5], i % 2, None, None) for i in range(6)]  # sums beyond 2^53
    assert got(spark, big) == expected(big)
    beyond = [(100 * i, [1e200 * (i + 1)], i % 2, None, None) for i in range(6)]  # sums beyond a long
    assert {r[-2] for r in got(spark, beyond)} <= {2**63 - 1}
    assert not got(spark, rows[:0])


def test_reading_stops_early():
    """One dimension decides: the threshold falls below the best scores long before the lists end."""
    r = np.random.default_rng(3)
    rows = np.floor(256 * r.normal(size=(4096, 8)))
    rows[:, 0] *= 100
    anchor = np.array([50.0, 1, -1, 1, -1, 1, -1, 0])
    best, read = op.Best(5), []

    def offer(found, scores):
        read.append(len(found))
        best.offer(scores, found)
    lists = Lists(rows)
    lists.search(anchor, lists.thresholds(anchor[None])[0], lambda: best.least, offer)
    scores = rows @ anchor
    assert [-s for s, _ in best.held] == sorted(scores, reverse=True)[:5]
    assert sum(read) < 1500
