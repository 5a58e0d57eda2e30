import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF01
from fixtures import DOCS, hostile, hostile_rows
from test_decontaminate import brute as contaminated_by
from test_minhash import brute as groups_of
from test_mixing import water_fill
from test_quality import measures
from test_tokens import plain

import __spark_entry__ as entry
from glosa.llm.minhash import one_of_each
from glosa.llm.quality import RULES


def stages(spark, docs, sf_dir):
    """Input and output rows of each stage."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        made = stage(spark, docs, sf_dir)
        assert name == corpus_pipeline.STAGES[-1][0] or made.columns == columns
        rows = [tuple(r) for r in made.collect()]
        out.append(([tuple(r) for r in docs.collect()], rows))
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def check(steps, benchmark):
    (a, b), (_, c), (_, d), (_, e), (_, f) = steps
    kept = collections.Counter(r[:2] for r in b)
    for r in a:
        assert not (measures(r[1])[1] and kept[r[:2]])
    # One row of each group, and nothing else, goes on.
    groups = collections.defaultdict(set)
    for (doc, n, component, _), k in groups_of([r[:2] for r in b], 5, 80).items():
        groups[component].add(doc)
    assert len({r[0] for r in c}) == len(c) or None in {r[0] for r in c}
    assert {r[0] for r in c} == set(groups) if None not in groups else True
    hits = contaminated_by([r[:2] for r in c], benchmark)
    clean = collections.Counter({k[0]: n for k, n in hits.items() if not k[5]})
    assert collections.Counter(r[0] for r in d) == clean
    sizes = collections.Counter()
    for r in d:
        sizes[r[3]] += len((r[1] or "").split())
    taken = collections.Counter()
    copies = collections.Counter(r[0] for r in e)
    for r in e:
        taken[r[3]] += len((r[1] or "").split())
    assert set(e) <= set(d) and max(copies.values(), default=0) <= 3
    largest = max((len((r[1] or "").split()) for r in d), default=0)
    assert all(abs(taken[s] - t) <= max(largest, 0.02 * t) for s, t in water_fill(sizes).items())
    want = plain(sorted([r[:2] for r in e], key=lambda r: (r[0] is None, r[0] or 0)))
    assert sorted(f) == sorted(want)


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    steps = stages(spark, docs, SF01)
    check(steps, bench)
    assert all(len(made) < len(given) for given, made in steps[:3])
    final = [tuple(r) for r in entry.queries()["pipeline"](spark, SF01).collect()]
    assert sorted(final) == sorted(steps[-1][1])
    # Good documents stay but for copies and benchmark passages.
    good = {r.doc_id for r in spark.read.parquet(f"{SF01}/labels.parquet").where("quality = 1").collect()}
    gone = {r[0] for r in steps[0][0]} - {r[0] for r in steps[0][1]}
    text = {r[0]: r[1] for r in steps[0][0]}
    assert all(measures(text[i])[1] for i in gone & good)


@pytest.mark.parametrize("rows", [hostile_rows(), []])
def test_hostile_and_empty_tables(spark, rows):
    steps = stages(spark, spark.createDataFrame(rows, DOCS), SF01)
    assert bool(steps[-1][1]) == bool(rows)
    # Null ids that are different documents both go on.
    kept = [r for r in steps[1][1] if r[0] is None]
    assert len(kept) == (1 if rows else 0)


def test_one_of_each_group_stays(spark):
    docs = hostile(spark).withColumn("row_hash", F.lit("clash"))
    rows = one_of_each(docs, shingle=5, num=80).collect()
    groups = groups_of([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    ids = collections.Counter(r.doc_id for r in rows)
    assert {k[2] for k in groups} == set(ids) and len(RULES) > 0


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
