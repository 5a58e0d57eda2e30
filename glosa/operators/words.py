"""Words of texts, counted where the texts lie.

Texts are split in Arrow batches by Python's ``str.split()``, which ``functions.text.tokens``
reproduces as a column; a word is counted before it leaves its task, so Spark shuffles and
joins a row for each different word of a text (or of a task) and not one for each occurrence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_WORDS = 200_000  # of a task's different words, before their counts leave it

_COUNTS = pa.list_(pa.struct([("token", pa.string()), ("_c", pa.int64())]))
_NUMBERS = pa.struct([(n, pa.int64()) for n in ("n", "s", "ss", "stop", "user", "medium")])
NUMBERS = "struct<n:bigint,s:bigint,ss:bigint,stop:bigint,user:bigint,medium:bigint>"


def words_of(texts: pa.Array) -> Iterator[list[str] | None]:
    """The words of each text of a batch, None for a null."""
    for text in texts.cast(pa.binary()):
        raw = text.as_py()
        yield None if raw is None else raw.decode("utf-8", "replace").split()


def word_frequencies(df: DataFrame, text: Column) -> DataFrame:
    """(token, _n): each different word of the texts and its occurrences."""
    def count(batches):
        held: Counter[str] = Counter()

        def whole():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "_n"])
        for batch in batches:
            for words in words_of(batch.column(0)):
                held.update(words or ())
                if len(held) > HELD_WORDS:
                    yield whole()
                    held.clear()
        if held:
            yield whole()
    parts = df.select(text.alias("_text")).mapInArrow(count, "token string, _n long")
    return parts.groupBy("token").agg(F.sum("_n").alias("_n"))


def counted_words(text: Column) -> Column:
    """Of a text its different words and their occurrences, an array of (token, _c); without words one null token and 0."""
    @F.arrow_udf("array<struct<token:string,_c:bigint>>")
    def counted(texts: pa.Array) -> pa.Array:
        own = (Counter(words or ()) or {None: 0} for words in words_of(texts))
        return pa.array([[{"token": t, "_c": c} for t, c in held.items()] for held in own], _COUNTS)
    return counted(text)


def word_counts(df: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """(keys, token, _c): the counted words of each row."""
    return df.select(*keys, F.explode(counted_words(text)).alias("_w")).select(*keys, "_w.token", "_w._c")


def word_numbers(text: Column, stopwords: Sequence[str], user: str, medium: str) -> Column:
    """Of a text's words: their number, the sum of their lengths and of its squares, and how many, lower-cased, are
    stop words and the two address words; null for a null text."""
    stop = frozenset(stopwords)

    @F.arrow_udf(NUMBERS)
    def numbers(texts: pa.Array, lower: pa.Array) -> pa.Array:
        out = []
        for words, low in zip(words_of(texts), words_of(lower)):
            if words is None:
                out.append(None)
                continue
            sizes, own = [*map(len, words)], Counter(low)
            out.append({"n": len(words), "s": sum(sizes), "ss": sum(s * s for s in sizes), "stop": sum(own[w] for w in stop if w in own),
                        "user": own[user], "medium": own[medium]})
        return pa.array(out, _NUMBERS)
    return numbers(text, F.lower(text))
