import re

from pyspark.sql import functions as F

from glosa.llm.url_filter import UrlRule, bloom_filter, canonical_url, url_verdicts

RULES = [UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"),
         UrlRule("allow", "org", "/fr/")]
URLS = ["http://a.example.net/en/1", "http://a.example.net/de/1", "https://EXAMPLE.NET/en/", "http://notexample.net/en/1",
        "http://example.com/de/x?y", "http://example.com/DE/x", "http://anexample.com/de/x", "http://org/fr/", "http://x.org/fr",
        "http://u:p@x.org/fr/1", "http://x.org:8080/fr/1", "http://net", "http://net/", "x://net?a=/", "://net/a", "net/", "", None,
        "http://", "a://b://net/c", "http://listed.example.org/a?b=2&a=1#f", "https://www.Listed.example.org:443/a/?a=1&utm_x=3&b=2",
        "http://listed.example.org/a?a=1", "ftp://listed.example.org/a?a=1&b=2", "http://ÄÖ.Org/fr/é", "http://x.org/é\n/b?c",
        "http://h.example.org/" + "a/" * 200_000]
LISTED = ["https://listed.example.org/a/?a=1&b=2", "http://a.example.net/en/1", None, "no url", "https://listed.example.org/a/?a=1&b=2"]


def canonical(url):
    if not url or "://" not in url:
        return None
    scheme, rest = url.split("://", 1)
    scheme = "".join(c.lower() if "A" <= c <= "Z" else c for c in scheme)
    rest = rest.split("#", 1)[0]
    place, _, query = rest.partition("?")
    host, path = re.fullmatch(r"(?s)([^/]*)(.*)", place).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host).rpartition("@")[2]
    host = re.sub(r":(80|443)?\Z", "", host).rstrip(".")
    host = host.removeprefix("www.")
    params = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|$)", p))
    return ("" if scheme in ("http", "https") else scheme + "://") + host + path.rstrip("/") + ("?" + "&".join(params) if params else "")


def judged(url, listed):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    form = canonical(url)
    return host, path, None, "block" if form is not None and form in {canonical(u) for u in listed} else "allow"


def test_hostile_urls(spark):
    """Nulls, odd and long urls, repeated rows, clashing column names."""
    rows = [(i, u, "x", 1, None) for i, u in enumerate(URLS)] + [(0, URLS[0], "x", 1, None), (None, URLS[20], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key int, block long")
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    out = url_verdicts(pages, listed, RULES).collect()
    assert sorted(map(str, ((r.row.page_id, r.row.host, r.host, r.path, r.rule, r.verdict) for r in out))) == sorted(
        map(str, ((i, h, *judged(u, LISTED)) for i, u, h, _, _ in rows)))
    assert {r.canonical for r in out} == {canonical(u) for u in URLS}


def test_false_positives_are_removed(spark):
    """A filter of one block passes nearly all pages on; the join still tells them apart."""
    listed = spark.range(3000).select(F.concat(F.lit("http://a.example.com/"), "id").alias("url"))
    pages = spark.range(6000).select("id", F.concat(F.lit("https://a.example.com/"), "id", F.lit("/#x")).alias("url"))
    tight = url_verdicts(pages, listed, [], max_blocks=1)
    wide = url_verdicts(pages, listed, [])
    for out in (tight, wide):
        assert {r[0] for r in out.where("verdict = 'block'").select("row.id").collect()} == set(range(3000))
    assert tight.where("possible").count() > 5900
    assert 3000 <= wide.where("possible").count() < 3100


def test_no_listed_form_is_missed_by_the_filter(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits, blocks = bloom_filter(keys, 5000)
    assert blocks == 256 and bits.count() <= blocks


def test_hot_form(spark):
    """A form that most pages have, and an empty list and table."""
    pages = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, F.lit("http://h.example.org/x")).otherwise(
        F.concat(F.lit("http://h.example.org/"), "id")).alias("url"))
    listed = pages.where("id < 10").select("url")
    out = url_verdicts(pages, listed, [])
    assert out.where("verdict = 'block'").count() == 20_000 - 6667 + 4
    assert url_verdicts(pages, listed.limit(0), RULES).where("verdict = 'block'").isEmpty()
    assert url_verdicts(pages.limit(0), listed, RULES).isEmpty()


def test_no_python_workers(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_verdicts(pages, pages, RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("ArrowEval|MapInArrow|BatchEvalPython|Cartesian|NestedLoop", plan)


def test_canonical_null(spark):
    df = spark.createDataFrame([(None,), ("x",)], "url string")
    assert [r[0] for r in df.select(canonical_url(F.col("url"))).collect()] == [None, None]
