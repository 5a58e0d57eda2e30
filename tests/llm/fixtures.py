"""Small hostile documents for the operator tests."""

import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def prose(seed: int, n: int) -> str:
    """``n`` words, a line break after each tenth."""
    words = [f"w{(seed * 7919 + i * (seed + 13)) % 9973}" for i in range(n)]
    return "\n".join(" ".join(words[i: i + 10]) for i in range(0, n, 10))


def hostile_rows() -> list[tuple]:
    """Nulls in each column, empty and long texts, ties, repeated rows and ids."""
    base = prose(1, 80)
    texts = [base, base, base.upper(), base + " tail", base.replace("\n", "\t"), prose(2, 60), prose(2, 60) + " x y z",
             "", None, "  \n\t ", "one", "one", "one two", "a b c d éİ", prose(3, 20_000),
             prose(3, 20_000) + " more words here", "x" * 300_000, "spam " * 400, "# $ % | <> " * 30]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (5, prose(4, 55), "de", None, 1), (None, base, "en", "s1", 2),
             (None, prose(5, 70), None, None, None), (90, prose(6, 90), "fr", "", 3), (91, None, None, None, None),
             (-7, prose(7, 50), "en", "sé", 4)]
    return rows


def hostile(spark):
    return spark.createDataFrame(hostile_rows(), DOCS)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
