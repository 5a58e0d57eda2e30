"""Operator 6: secrets in texts, and weak candidates by multipart linking.

Strong spans (assignments to secret names, access identifiers, long hex runs)
are reported as they stand. Weak candidates are reported only next to their
complements: a bare 40-character key or an identifier assignment needs the
other within ``scope`` code points (strong spans count as well), an endpoint
needs an identifier and a secret.

A text's matches and the pieces between them give the places of matches. The
links are an interval join: each part lies in the bins of ``scope`` code points
that it covers and is looked for from the bins it can reach, per document,
role and bin with the least start and the greatest end only, so no pairs are
made. Built-in functions only.

A null text has no spans. Repeated rows are searched once and each gets the
result; ids may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosa.llm.common import stored

# Strong patterns: fixed values of the contract. Lengths are checked on the matches.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
# Weak patterns.
KEY = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
IDENT = r"""(?i)(?<![a-z0-9])(user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""(?i)https?://[^\x00-\x20"'<>]+"""

KINDS = ["assign", "access", "hex", "key", "ident", "endpoint"]
STRONG = KINDS[:3]
PATTERNS = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, KEY, IDENT, ENDPOINT], strict=True))
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "ident": "id", "endpoint": "endpoint"}


def _parts(kind: str) -> Column:
    """Matches of a kind with the length of the text before each since the last."""
    text, pattern = F.col("text"), F.lit(PATTERNS[kind])
    found = F.zip_with(F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0)),
                       lambda p, m: F.struct(F.lit(kind).alias("kind"), F.length(p).alias("skip"), m.alias("match")))
    return F.when(text.rlike(PATTERNS[kind]), found)


def _spans(searched: DataFrame) -> DataFrame:
    """k1, k2, kind, start, end, match of every match that is long enough."""
    once = searched.where("size(parts) > 0").dropDuplicates(["k1", "k2"])
    rows = once.select("k1", "k2", F.posexplode("parts").alias("i", "p")).select("k1", "k2", "i", "p.*")
    width = F.length("match").cast("long")
    end = F.sum(F.col("skip") + width).over(W.partitionBy("k1", "k2", "kind").orderBy("i"))
    rows = rows.where("match is not null").withColumn("end", end).withColumn("start", F.col("end") - width)
    short = (((F.col("kind") == "assign") & (F.length(F.regexp_extract("match", ASSIGN, 2)) < 8))
             | ((F.col("kind") == "access") & (F.length("match") < 16))
             | ((F.col("kind") == "key") & F.col("match").rlike("^[0-9a-f]+$")))
    return rows.where(~short).select("k1", "k2", "kind", "start", "end", "match")


def _near(probe: DataFrame, parts: DataFrame, role: str, scope: int) -> DataFrame:
    """The probe's spans that have a part of ``role`` within ``scope`` code points."""
    bins = F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))
    held = (parts.where(F.col("role") == role).select("k1", "k2", F.explode(bins).alias("bin"), "start", "end")
            .groupBy("k1", "k2", "bin").agg(F.min("start").alias("least"), F.max("end").alias("most")))
    reach = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    seen = probe.select("k1", "k2", "kind", "start", "end", F.explode(reach).alias("bin")).join(held, ["k1", "k2", "bin"])
    seen = seen.where((F.col("most") >= F.col("start") - scope) & (F.col("least") <= F.col("end") + scope))
    return seen.select("k1", "k2", "kind", "start", "end").distinct()


def find_spans(searched: DataFrame, scope: int) -> DataFrame:
    """All reported spans: k1, k2, kind, start, end, match, weak."""
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    spans = stored(_spans(searched).withColumn("role", role[F.col("kind")]), "spans")
    weak = spans.where(~F.col("kind").isin(STRONG))
    has_id = _near(weak.where("role <> 'id'"), spans, "id", scope)
    has_secret = _near(weak.where("role <> 'secret'"), spans, "secret", scope)
    keys = ["k1", "k2", "kind", "start", "end"]
    linked = (has_id.where("kind = 'key'").unionByName(has_secret.where("kind = 'ident'"))
              .unionByName(has_id.join(has_secret, keys).where("kind = 'endpoint'").select(keys)))
    strong = spans.where(F.col("kind").isin(STRONG)).select(*keys, "match", F.lit(False).alias("weak"))
    return strong.unionByName(weak.join(linked, keys, "left_semi").select(*keys, "match", F.lit(True).alias("weak")))


def searched_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a 128-bit key of id and text, and the matches of every row, stored."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("k1", F.xxhash64("id", "text")).withColumn("k2", F.xxhash64("text", F.lit(1), "id"))
    none = F.array().cast("array<struct<kind:string,skip:int,match:string>>")
    parts = F.concat(*[F.coalesce(_parts(k), none) for k in KINDS])
    # Texts with nothing but endpoints, or with one weak kind alone, report nothing.
    some = F.exists("parts", lambda p: p.kind.isin(STRONG)) | (
        F.exists("parts", lambda p: p.kind == "key") & F.exists("parts", lambda p: p.kind == "ident"))
    docs = docs.select("id", "k1", "k2", F.explode(F.array(parts)).alias("parts"))
    return stored(docs.select("id", "k1", "k2", F.when(some, F.col("parts")).alias("parts")), "searched")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scope: int = 200) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_weak.

    Spans are code points, end exclusive, by start and then kind. An empty table
    gives no rows.
    """
    searched = searched_texts(docs, id_col, text_col)
    found = find_spans(searched, scope)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = F.struct("start", place.alias("place"), "end", "kind")
    listed = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(one)).alias("all"))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("all", lambda s: s.kind == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    base = F.filter("all", lambda s: s.place <= len(STRONG))
    out = searched.select("id", "k1", "k2").join(listed, ["k1", "k2"], "left")
    weak = F.coalesce(F.size(F.filter("all", lambda s: s.place > len(STRONG))), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), *[count(k) for k in STRONG],
                      F.sha2(F.coalesce(text(base), F.lit("")), 256).alias("base_sha256"),
                      F.coalesce(text(F.col("all")), F.lit("")).alias("spans"), weak.alias("n_weak"))
