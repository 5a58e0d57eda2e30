import collections

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SF01
from fixtures import DOCS, WORD, hostile, prose, words

from glosa.llm.quality import BASE, RULES, Rule, measured, order_rules, quality_cascade


def measures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    n = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    return n, len(w) < 50 or 100 * len(covered) > 50 * len(w)


def check(rows, texts):
    got = collections.Counter((r.doc_id, tuple(r[c] for c in BASE), r.base_failed) for r in rows)
    assert got == collections.Counter((i, *measures(t)) for i, t in texts)
    assert not any(r.kept and r.base_failed for r in rows)


def test_measures_match_brute_force(spark):
    t = pq.read_table(f"{SF01}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = quality_cascade(spark.read.parquet(f"{SF01}/documents.parquet")).select(
        "row.doc_id", *BASE, "base_failed", "kept").collect()
    check(rows, [(r["doc_id"], r["text"]) for r in t])


def test_hostile_rows(spark):
    docs = hostile(spark).withColumn("n_words", F.lit("clash")).withColumn("row", F.lit(1))
    rows = quality_cascade(docs).select("row.doc_id", *BASE, "base_failed", "kept").collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_labelled_documents(spark):
    """Good documents that pass the base limits stay; of the bad ones most go."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id")
    rows = quality_cascade(docs).where("not base_failed").select("row.quality", "rejected_by").collect()
    assert all(r.rejected_by is None for r in rows if r.quality == 1)
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.rejected_by is not None for r in bad) > 0.9 * len(bad)


def test_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    for rules in (RULES, RULES[::-1]):
        out = quality_cascade(docs, rules=rules, sample_rows=10**9)
        kept = {r[0] for r in out.where("kept").select("row.doc_id").collect()}
        assert kept == {r[0] for r in quality_cascade(docs, sample_rows=50).where("kept").select("row.doc_id").collect()}


def test_cheap_selective_rules_come_first(spark):
    rows = [(i, prose(i, 60 + i), "en", "s", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS).select("text")
    rules = [Rule("none", "n_words < 0"), Rule("half", "n_words >= 110"), Rule("same", "n_words >= 111"),
             Rule("rest", "n_words >= 61")]
    order = order_rules(docs, rules, 10**6)
    assert [r.name for r, _, _ in order][0] == "rest"
    assert [round(p, 2) for r, p, _ in order if r.name != "rest"] == [0, 0, 0]


def test_windows_overlap_and_touch(spark):
    texts = ["a b c a b c", "a a a a", "a b c x a b c b c a b c", "a b", "a b c d", "k l m n k l m n o l m n o"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in measured(docs).collect()}
    assert got == {i: measures(t)[0][4] for i, t in enumerate(texts)}


def test_empty_table(spark):
    assert quality_cascade(spark.createDataFrame([], DOCS)).collect() == []


def test_clean_documents_stay(spark):
    """One line, a data URI and scripts without spaces are no reason to reject; junk of the same kinds goes."""
    line = prose(11, 200).replace("\n", " ")
    uri = "data:image/png;base64," + "iVBORw0KGgoAAAANSUhEUgAA" * 500
    chinese, more = ("\n".join(f"第{i}段说明了这个方法在实际数据上的效果以及它的限制条件和适用范围。" for i in r)
                     for r in (range(60), range(60, 900)))
    japanese = "\n".join(f"第{i}章ではこの手法の効果とその限界について、データを用いて詳しく説明します。" for i in range(60))
    thai = "\n".join(f"บทที่{i}อธิบายวิธีการนี้และผลลัพธ์ที่ได้จากข้อมูลจริงอย่างละเอียด" for i in range(60))
    stay = {"line ...": line + " ...", "line …": line + "…\n", "line -": "- " + line,
            "two lines": f"- {line}\n* " + prose(17, 90).replace("\n", " ") + "...",
            "uri": prose(12, 4000) + f"\n{uri}\n" + prose(13, 60), "longest uri": prose(12, 6000) + "\n" + uri * 2,
            "chinese": chinese, "japanese": japanese, "thai": thai,
            **{f"{k} paragraph": f"{t}\n{''.join(t.split()) * 2}" for k, t in
               (("chinese", chinese), ("japanese", japanese), ("thai", thai))},
            "chinese uri": more + "如图" + uri}
    words = prose(14, 60).split()
    go = {"bullets": "\n".join("- " + " ".join(words[i: i + 6]) for i in range(0, 60, 6)),
          "ellipses": "\n".join(" ".join(words[i: i + 6]) + "..." for i in range(0, 60, 6)),
          "word_length": " ".join(w * 4 for w in words),
          "short words": " ".join(chr(97 + i // 26) + chr(97 + i % 26) for i in range(600)) + " "
                         + uri[:1000],
          "giant_word": prose(15, 60) + " " + uri, "giant_word in chinese": chinese + uri}
    docs = spark.createDataFrame([*stay.items(), *go.items()], "name string, text string")
    got = {r.name: (r.base_failed, r.rejected_by) for r in
           quality_cascade(docs).select("row.name", "base_failed", "rejected_by").collect()}
    assert {k: got[k] for k in stay} == {k: (False, None) for k in stay}
    assert all(got[k][1] not in (None, "base") for k in go), got
