"""Operator 9: document quality rules as a short-circuit cascade.

Every document gets its base measures. Those that pass the base limits go
through further rules one after the other, and a document that one rejects is
not shown to the later ones. The order comes from a sample: each rule's cost is
the time it takes there and its rejection the share of the rows still left
that it rejects; the rule with the highest rejection per cost comes first, then
the highest among the rows which that one leaves, and so on. The order changes
what a rejection is put down to and the run time, never which documents stay.

Built-in column expressions only. A null text counts as empty: no words, so
the base limits reject it. Ids are carried along as they are, null or repeated.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import WORD, drop_stored, stored

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
# Scripts written without spaces between words: there, a run without white space is a sentence or a paragraph.
UNSPACED = (r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsYi}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
            r"\p{IsJavanese}\p{IsBalinese}\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}")
# Patterns start where a word or a run begins and never give back, so that a long word is read once.
GIANT = rf"(?<![^\x20\x09-\x0D{UNSPACED}])[^\x20\x09-\x0D{UNSPACED}]{{1000,}}+"
BEGIN = r"(?<![^\x20\x09-\x0D])"
WITH_LETTER = BEGIN + r"[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+"
IN_CAPITALS = BEGIN + r"(?=[^\x20\x09-\x0D\p{Ll}]*+(?![^\x20\x09-\x0D]))[^\x20\x09-\x0D]*?\p{Lu}{2}[^\x20\x09-\x0D]*+"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over ``text`` (never null), the base measures, ``n_lines``, ``n_giant`` and ``giant_chars``."""
    name: str
    rejects: str


# Limits for prose: symbols a word, repeated and bulleted lines, word lengths,
# words with a letter, words in capitals, and characters in giant words. A length
# of words says something only if most letters are of a script with spaces, and
# shares of lines only if there are several; giant words (a data URI) have no
# length that counts, and a text goes for them only if they are most of it.
MIN_LINES = 5
RULES = [
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "(word_chars - giant_chars < 3 * (n_words - n_giant) or word_chars - giant_chars > 10 * (n_words - n_giant))"
         rf" and 2 * regexp_count(text, r'[{UNSPACED}&&\p{{L}}]') <= regexp_count(text, r'\p{{L}}')"),
    Rule("few_letters", f"10 * regexp_count(text, r'{WITH_LETTER}') < 7 * n_words"),
    Rule("capitals", f"2 * regexp_count(text, r'{IN_CAPITALS}') > n_words"),
    Rule("bullets", rf"n_lines >= {MIN_LINES} and 10 * regexp_count(text, r'(?md)^[\x20\x09]*[-*•]') > 9 * n_lines"),
    Rule("ellipses", rf"n_lines >= {MIN_LINES} and 10 * regexp_count(text, r'(?md)(\.\.\.|…)[\x20\x09]*$') > 3 * n_lines"),
    Rule("giant_word", "2 * giant_chars > word_chars"),
]


def measured(docs: DataFrame) -> DataFrame:
    """Add the base measures to a frame that has ``text`` (not null).

    Three-word windows are compared by 64-bit hashes of their words. Only a
    document that has a repeated window sorts them: neighbours with equal
    hashes repeat, and each repeated window covers up to three words more than
    the one before it. Giant words are those with a run of 1,000 or more characters
    of no unspaced script; ``giant_chars`` is the length of these runs.
    """
    columns = docs.columns
    docs = docs.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    docs = docs.withColumn("n_words", F.size("words").cast("long")).withColumn(
        "word_chars", F.length(F.array_join("words", "")).cast("long"))
    docs = docs.withColumn("giant", F.filter("words", lambda w: (F.length(w) >= 1000) & w.rlike(GIANT)))
    docs = docs.withColumn("n_giant", F.size("giant").cast("long")).withColumn("giant_chars", F.aggregate(
        "giant", F.lit(0).cast("long"), lambda a, w: a + F.length(w) - F.length(F.regexp_replace(w, GIANT, ""))))
    docs = docs.withColumn("n_symbols", F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"))
    docs = docs.withColumn("lines", F.split("text", "\n", -1))
    docs = docs.withColumn("n_lines", F.size("lines").cast("long"))
    docs = docs.withColumn("lines", F.filter("lines", lambda x: x.rlike(WORD)))
    docs = docs.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    docs = docs.withColumn("windows", F.expr(
        "if(n_words < 3, array(), transform(sequence(0, cast(n_words as int) - 3),"
        " i -> xxhash64(words[i], words[i + 1], words[i + 2])))"))
    docs = docs.withColumn("placed", F.expr(
        "if(size(array_distinct(windows)) = size(windows), array(),"
        " sort_array(transform(windows, (h, i) -> struct(h, i))))"))
    docs = docs.withColumn("repeated", F.expr(
        "sort_array(transform(filter(transform(placed, (p, j) -> struct(p.i as i,"
        " (j > 0 and get(placed, j - 1).h = p.h) or (j + 1 < size(placed) and get(placed, j + 1).h = p.h) as twice)),"
        " p -> p.twice), p -> p.i))"))
    docs = docs.withColumn("n_repeat_words", F.expr(
        "aggregate(repeated, struct(-3 as last, 0L as n),"
        " (a, i) -> struct(i as last, a.n + least(3, i - a.last) as n), a -> a.n)"))
    # A filter on what a generator makes stays above it; below, the optimizer would
    # replace each measure by its definition, and those in it by theirs.
    return docs.select(*columns, F.inline(F.array(F.struct(*BASE, "n_lines", "n_giant", "giant_chars"))))


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, rejection, seconds) in cascade order, from a sample of about ``sample_rows`` rows."""
    total = docs.count()
    sample = docs if total <= sample_rows else docs.sample(fraction=sample_rows / total, seed=seed)
    sample = stored(measured(sample.select("text")).where(~base_failed()), "sample")
    costs = []
    for r in rules:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.count_if(F.expr(r.rejects))).first()
            runs.append(time.perf_counter() - began)
        costs.append(min(runs))
    flags = F.array(*[F.coalesce(F.expr(r.rejects), F.lit(False)) for r in rules])
    # At most 2^rules different patterns of rejections.
    patterns = [(p["flags"], p["n"]) for p in
                sample.groupBy(flags.alias("flags")).agg(F.count(F.lit(1)).alias("n")).collect()]
    drop_stored(sample)
    order, left = [], list(range(len(rules)))
    while left:
        rows = sum(n for _, n in patterns) or 1
        rejection = {k: sum(n for f, n in patterns if f[k]) / rows for k in left}
        best = max(left, key=lambda k: (rejection[k] / costs[k], -costs[k]))
        order.append((rules[best], rejection[best], costs[best]))
        patterns = [(f, n) for f, n in patterns if not f[best]]
        left.remove(best)
    return order


def quality_cascade(docs: DataFrame, text_col: str = "text", *, rules: list[Rule] | None = None,
                    sample_rows: int = 2000) -> DataFrame:
    """Base measures, ``base_failed``, ``rejected_by`` (null: by none) and ``kept`` of every row.

    The input row is carried whole as the struct ``row``, so its own columns
    may have any names. An empty table gives no rows.
    """
    docs = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = order_rules(docs, RULES if rules is None else rules, sample_rows)
    verdict = F.when(base_failed(), F.lit("base"))
    for rule, _, _ in order:
        verdict = verdict.when(F.expr(rule.rejects), F.lit(rule.name))
    out = measured(docs).withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict)
    return out.select("row", *BASE, "base_failed", "rejected_by", F.col("rejected_by").isNull().alias("kept"))
