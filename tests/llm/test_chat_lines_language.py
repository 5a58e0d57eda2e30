import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF01

from glosa.llm.chat import format_chats
from glosa.llm.language import _classes, fit_text_model, identify, page_items
from glosa.llm.line_dedup import site_lines

TURNS = "conv_id long, turn long, role string, text string"


def brute_chats(rows):
    convs = collections.defaultdict(set)
    for i, (conv, turn, role, text) in enumerate(rows):
        role, text = role or "unknown" if role is None else role, text or ""
        convs[("c", conv) if conv is not None else ("n", role, text)].add((turn if conv is not None else None, role, text))
    seqs = collections.defaultdict(list)
    for key, turns in convs.items():
        order = sorted(turns, key=lambda t: (t[0] is None, t[0] or 0, t[1], t[2]))
        seqs[tuple((r, t) for _, r, t in order)].append(key[1] if key[0] == "c" else None)
    out = collections.Counter()
    for seq, ids in seqs.items():
        if not any(len(o) > len(seq) and o[: len(seq)] == seq for o in seqs):
            known = [i for i in ids if i is not None]
            out[(min(known) if known else None, len(seq), len(ids),
                 "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in seq))] += 1
    return out


def chats(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_chats_match_brute_force(spark):
    rng, rows = random.Random(2), []
    for conv in range(60):
        turns = [("user" if k % 2 == 0 else "assistant", f"t{rng.randint(0, 1)}") for k in range(rng.randint(1, 6))]
        rows += [(conv, k * 10, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(100, None, None, None), (100, 1, "user", ""), (101, 1, "user", "x" * 200_000), (101, 1, "user", "x" * 200_000),
             (102, 1, "user", "x" * 200_000), (102, 1, "user", "other"), (None, 3, "user", "lone"), (None, 9, "user", "lone"),
             (None, None, None, None), (103, 1, "user", "lone"), (-5, 2, "system", "é😀")]
    df = spark.createDataFrame(rows, TURNS).repartition(5).withColumn("place", F.lit("clash"))
    assert chats(format_chats(df)) == brute_chats(rows)


def test_many_snapshots_of_one_conversation(spark):
    rows = [(conv, k, "user", f"turn {k}") for conv in range(200) for k in range(1 + conv % 40)]
    assert chats(format_chats(spark.createDataFrame(rows, TURNS))) == brute_chats(rows)
    assert format_chats(spark.createDataFrame([], TURNS)).collect() == []


def test_site_lines(spark):
    nav = "<nav><ul><li>Home</li><li>About  us</li></ul></nav>"
    rows = [(i, f"https://User@A.example:80/{i}", f"<html>{nav}<!-- x\n --><p>own {i}</p><script>var a='<p>no</p>'</script>"
             f"<div>{'shared' if i < 2 else 'mine ' + str(i)}</div>x <b>bold</b> y</html>") for i in range(10)]
    rows += [(50 + i, "http://small.example/", nav) for i in range(9)]
    rows += [(80 + i, "http://two.example/", nav) for i in range(2)]
    rows += [(70, None, nav), (71, "no host", None), (72, "http://a.example/", "plain\n\n text "), (None, "", "")]
    rows += [rows[0]] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit("clash"))
    got = {(r.page_id, r.host, r.n_lines, r.n_dropped, r.text) for r in site_lines(df).collect()}
    # a.example: 13 pages; nav lines on 12 of them, "shared" on 4 (two of them the repeated row).
    assert (0, "a.example", 5, 4, "own 0") in got or (0, "a.example", 5, 5, "") in got
    assert (5, "a.example", 5, 3, "own 5\nmine 5") in got
    # A small host is judged alike: 9 of 9 pages; two pages of another say nothing.
    assert (50, "small.example", 2, 2, "") in got and (80, "two.example", 2, 0, "Home\nAbout us") in got
    assert {(70, "", 2, 0, "Home\nAbout us"), (71, "", 0, 0, ""), (None, "", 0, 0, ""),
            (72, "a.example", 2, 0, "plain\ntext")} <= got
    assert site_lines(df).count() == len(rows)
    assert site_lines(df.limit(0)).collect() == []


def test_held_out_documents_and_weak_texts(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    split = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = fit_text_model(docs.where(split), "text", "lang", 300)
    held = docs.where(~split).select("lang", "text", F.lit(None).cast("string").alias("markup"),
                                     F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"),
                                     F.lit(None).cast("string").alias("parent"))
    rows = identify(held, model).collect()
    right = [r.language == r.row.lang for r in rows if r.text_language]
    assert sum(right) > 0.97 * len(right)
    # A host of one language and the markup speak for texts that do not.
    extra = [("de", prose_of(docs, "de"), "de", "de", "h.de", "x.de")] * 30
    extra += [("?", "", "de", "de", "h.de", "x.de"), ("?", "123", "de", None, "h.de", None), ("?", None, None, None, None, None)]
    items = spark.createDataFrame(extra, "lang string, text string, markup string, suffix string, host string, parent string")
    out = identify(held.unionByName(items), model).where("row.lang = '?'").collect()
    assert [r.language for r in out if r.row.host] == ["de", "de"] and all(0 < r.probability <= 1 for r in out)
    assert sorted(r.text_language is None for r in out) == [False, True, True]


def prose_of(docs, lang):
    return docs.where(F.col("lang") == lang).orderBy("doc_id").first().text


def test_fusion_formula(spark):
    langs, table = ["a", "b"], np.log(np.random.default_rng(1).dirichlet(np.ones(1 << 16), 2)).astype(np.float32)
    rows = [(i, ["xyz abc", "hello there", "", None, "qrs tuv wxy"][i % 5], ["a", "b", None][i % 3], ["com", None][i % 2],
             ["h1", "h2", None][i % 3], ["p", None][i % 2]) for i in range(40)]
    # The parent is a function of the host.
    rows = [(*r[:5], {"h1": "p", "h2": "p", None: None}[r[4]]) for r in rows]
    df = spark.createDataFrame(rows, "id long, text string, markup string, suffix string, host string, parent string")
    got = {r.row.id: (r.language, r.probability) for r in identify(df, (langs, table)).collect()}
    score = {r[0]: [float(table[k][_classes(r[1].encode())].sum(dtype=np.float64)) if r[1] else 0.0 for k in (0, 1)] for r in rows}
    vote = {r[0]: (int(np.argmax(score[r[0]])) if r[1] else None) for r in rows}

    def votes(at, value):
        return [sum(vote[r[0]] == k and (at is None or r[at] == value) for r in rows) for k in (0, 1)]
    every = votes(None, None)
    overall = [(v + 1) / (sum(every) + 2) for v in every]
    sizes = {2: 2, 3: 1}
    for r in rows:
        prior = overall
        if r[4] is not None:
            pv, hv = votes(5, r[5]), votes(4, r[4])
            parent = [(pv[k] + 20 * overall[k]) / (sum(pv) + 20) for k in (0, 1)]
            hv = [hv[k] - (vote[r[0]] == k) for k in (0, 1)]
            prior = [(hv[k] + 20 * parent[k]) / (sum(hv) + 20) for k in (0, 1)]
        terms = [0.1 * score[r[0]][k] + math.log(prior[k]) for k in (0, 1)]
        for at in (2, 3):
            if r[at] is not None:
                given = votes(at, r[at])
                terms = [terms[k] + math.log((given[k] + 1) / (every[k] + sizes[at] + 1)) for k in (0, 1)]
        best = int(terms[1] > terms[0])
        p = 1 / sum(math.exp(t - max(terms)) for t in terms)
        assert got[r[0]][0] == langs[best] and abs(got[r[0]][1] - p) < 1e-6


def test_page_items(spark):
    rows = [(1, "https://m.Blog.example.com/fr/1", '<HTML class=x LANG="FR-ca"><p>Bonjour</p>'), (2, None, None),
            (3, "http://localhost/x", "<html><p lang=de>x</p>")]
    got = {r.page.page_id: (r.text, r.markup, r.suffix, r.host, r.parent)
           for r in page_items(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("Bonjour", "fr", "com", "m.blog.example.com", "example.com"), 2: (None, None, None, None, None),
                   3: ("x", None, None, "localhost", None)}


def test_rare_languages_and_copies(spark):
    """Each labelled language is in the model, however large the others or their groups of copies are."""
    rows = [(f"common text number {i}", "aa") for i in range(3000)] + [(f"другой текст {i}", "zz") for i in range(3)]
    df = spark.createDataFrame(rows, "text string, lang string")
    langs, table = fit_text_model(df, "text", "lang", 40)
    assert langs == ["aa", "zz"]
    text = "другой текст".encode()
    assert table[1][_classes(text)].sum() > table[0][_classes(text)].sum()
    # Thousands of copies of the text whose hash is the least.
    hashed = df.orderBy(F.xxhash64(F.col("text").cast("binary"), "lang")).first()
    copies = spark.createDataFrame([tuple(hashed)] * 3000, df.schema)
    again = fit_text_model(df.unionByName(copies), "text", "lang", 40)
    assert again[0] == langs and np.array_equal(again[1], table)


def test_quotas():
    from glosa.llm.language import quotas
    assert quotas({"a": 10**7, "b": 1000, "c": 5}, 4000) == {"c": 5, "b": 1000, "a": 2995}
    assert quotas({"a": 900, "b": 100}, 4000) == {"a": 900, "b": 100}
    assert set(quotas({f"l{i}": 10**6 for i in range(200)}, 4000).values()) == {100}


def test_bare_angle_brackets_are_text(spark):
    from glosa.llm.line_dedup import lines_of
    pages = {"<p>if a < b then</p><p>a second paragraph</p><p>a third <b>bold</b> one</p>":
             ["if a < b then", "a second paragraph", "a third bold one"],
             "<p>x <5 and 6> y <i>z</i></p>": ["x <5 and 6> y z"],
             "a <a title='p < q' href=\"/x\">link</a> <img alt=it's> <!DOCTYPE x><br/>b</ i><?x y?>": ["a link", "b"],
             "<p>" + "<img src=x " + "a='1' " * 20_000 + "data-x='" + "y" * 300_000 + "'>end": ["end"]}
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    got = {r.k: r.l for r in df.select("k", lines_of(F.col("html")).alias("l")).collect()}
    assert got == dict(enumerate(pages.values()))
