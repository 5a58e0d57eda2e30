import collections
import hashlib
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SF01
from fixtures import DOCS, hostile, hostile_rows, prose

from glosa.llm.queries import QUERIES
from glosa.llm.secrets import KINDS, secrets

# The contract's patterns, and this library's weak ones, for Python's re.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
KEY = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
IDENT = re.compile(r"""(?<![a-z0-9])(user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.I | re.A)
ENDPOINT = re.compile(r"""https?://[^\x00-\x20"'<>]+""", re.I | re.A)


def brute(text, scope=200):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    keys = [(m.start(), 3, m.end()) for m in KEY.finditer(text) if not re.fullmatch("[0-9a-f]+", m[0])]
    idents = [(m.start(), 4, m.end()) for m in IDENT.finditer(text)]
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    ids = [s for s in base if s[1] == 1] + idents
    held = [s for s in base if s[1] != 1] + keys
    near = lambda x, ys: any(y[2] >= x[0] - scope and y[0] <= x[2] + scope for y in ys)
    weak = [k for k in keys if near(k, ids)] + [i for i in idents if near(i, held)]
    weak += [e for e in ends if near(e, ids) and near(e, held)]
    join = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(join(base).encode()).hexdigest(),
            join(base + weak))


def rows_of(df):
    return collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in df.collect())


def test_query_matches_brute_force(spark):
    t = pq.read_table(f"{SF01}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = rows_of(QUERIES["op6_multipart_secrets"](spark, SF01))
    assert got == collections.Counter((r["doc_id"], *brute(r["text"])) for r in t)
    assert any(r[1] for r in got)


def test_hostile_and_planted_rows(spark):
    k40, h64 = "Ab0/" * 10, "0123456789abcdef" * 4
    texts = ["token=secret: abcdefghij", 'API_KEY" :  "abcdefgh" password=short passwd:12345678', f"AKIA{'Z9' * 7} {k40}",
             k40, f"user=bob {k40}", f"user=bob {'x ' * 150}{k40}", f"client_id: abc https://a.b/c {h64}", f"https://a.b {h64}",
             f"login=joe\n{'é😀' * 60}\nhttps://x.y {k40}" * 40, f"AKIAAKIA{'A' * 12}AKIA1 {h64[:31]} {h64[:33]}é{h64}",
             "account = me " + "a" * 39 + " " + "B" * 41, "".join(f"token={'q' * 9} user=u{i}xx " for i in range(500)),
             f"secret=abcdefgh{'z' * 50_000} user=abc", f"😀 ñ password='ñabcdefgh' token=abcdefg/=+-_. AKIA{'0' * 12}"]
    rows = hostile_rows() + [(200 + i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(201, texts[1], "en", "s", 0)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumn("parts", F.lit("clash")).withColumn("k1", F.lit(1))
    got = rows_of(secrets(docs))
    want = collections.Counter((r[0], *brute(r[1])) for r in rows)
    assert got == want, [(a, b) for a, b in zip(sorted(got - want, key=str), sorted(want - got, key=str))][:2]


def test_clean_documents_report_nothing(spark):
    docs = spark.createDataFrame([(i, prose(i, 200) + " https://a.b/c user=someone", "en", "s", 0) for i in range(20)], DOCS)
    assert all(not r.spans for r in secrets(docs).collect())


def test_empty_table(spark):
    assert secrets(spark.createDataFrame([], DOCS)).collect() == [] and hostile(spark).count()
