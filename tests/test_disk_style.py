"""F5 of round 4: what moves and what is left on disk, on rows of their own."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosa.operators.style import StyleModel, pooled_windows, scored_windows, seeded_style_model, style_vectors, word_table
from glosa.session import CLEANUP, copies_dropped, cut_lineage, path_exists
from glosa.sources import lookups as lt

DOCS = [(1, "aa bb aa cc dd"), (1, "aa bb aa cc dd"), (2, "bb " * 30 + "ee"), (3, ""), (4, None), (None, "ff aa gg zz"), (None, "ff aa gg zz"),
        (5, "QQ qq"), (6, " \t ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "comment_id long, c_text string")


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        if (name := files.next().getName()).startswith("shuffle_"):
            found.add(name)
    return found


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    """A copy in the shared folder takes the place of the shuffles it was made from."""
    before, kept = _shuffle_files(spark), spark.conf.get(CLEANUP)
    out = cut_lineage(spark.range(2000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s")))
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before and spark.conf.get(CLEANUP) == kept
    assert out.count() == 100 and out.agg(F.sum("s")).first()[0] == 1999 * 1000


def test_a_failed_write_keeps_the_setting(spark):
    kept = spark.conf.get(CLEANUP)
    with pytest.raises(Exception):
        cut_lineage(spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x")))
    assert spark.conf.get(CLEANUP) == kept


def test_copies_go_with_what_they_were_for(spark):
    """only what is made inside goes, also after an error."""
    kept = cut_lineage(spark.range(3))
    with pytest.raises(RuntimeError), copies_dropped(spark):
        own = [cut_lineage(spark.range(4)), cut_lineage(kept)]
        with copies_dropped(spark):
            inner = cut_lineage(own[0])
            assert inner.count() == 4
        assert not path_exists(spark, inner.inputFiles()[0] if inner.inputFiles() else "/none") and [d.count() for d in own] == [4, 3]
        paths = [d.inputFiles()[0] for d in own]
        raise RuntimeError
    assert not any(path_exists(spark, p) for p in paths) and kept.count() == 3


def test_a_text_leaves_its_task_as_one_row(spark, docs):
    """windows are pooled where they are scored; texts without words are among the results."""
    model = StyleModel(seeded_style_model(3), 3, lt.derived_word_vocab(docs), lt.derived_char_vocab(spark), window=7, hop=5)
    words = word_table(docs, model)
    parts = pooled_windows(docs, words, model).collect()
    keys = {(d, t) for d, t in DOCS}
    assert len(parts) == len(keys)
    scored = scored_windows(docs, words, model).collect()
    assert len(scored) > len({r.key for r in scored})
    for r in parts:
        own = [(w.score, np.array(w.vector)) for w in scored if w.key == r.key]
        e = [np.exp(s - r.score) for s, _ in own]  # weights add up to one
        assert np.allclose(r.vector, sum((a * v for a, (_, v) in zip(e, own)), np.zeros(3)), atol=1e-12) and (not own or abs(sum(e) - 1) < 1e-9)
    vectors = style_vectors(docs, model)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert vectors.count() == len(keys) and "Join" not in plan and plan.count("Exchange") == 1
