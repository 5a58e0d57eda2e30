"""Scalar text features as JVM-side column expressions (no Python UDFs).

Every feature here is row-local: a projection over the comment table that
stays inside whole-stage codegen and scales with the number of partitions.
Null text gives null features; an empty token list gives a null ratio/mean/std
(``try_divide``) instead of the reference's NaN.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being matched)
# ---------------------------------------------------------------------------
# The code points Python's str.split()/str.isspace() treat as whitespace,
# written as a regex character-class body usable by Java and RE2 alike.
PY_WHITESPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS_RUN = f"[{PY_WHITESPACE}]+"
NON_WS = f"[^{PY_WHITESPACE}]"

# Offset inside the log so that a zero count stays finite.
LOG_EPS = 1e-9

# Reference-style patterns: ``http*\S+`` counts references (``httx`` counts
# too); cleaning drops ``https*\S+`` and ``@\S+``.
REFERENCE_PATTERN = f"http*{NON_WS}+"
CLEAN_URL_PATTERN = f"https*{NON_WS}+"
CLEAN_MENTION_PATTERN = f"@{NON_WS}+"
CLEAN_KEEP_CHARS = "[^A-Za-züöäÖÜÄß ]"
# The same rule as runs of kept characters: joining them deletes everything else.
CLEAN_KEEP_RUN = "[A-Za-züöäÖÜÄß ]+"

# Digits are spelled out in German before cleaning, in this order.
DIGIT_WORDS = [
    ("0", " null"), ("1", " eins"), ("2", " zwei"), ("3", " drei"), ("4", " vier"),
    ("5", " fünf"), ("6", " sechs"), ("7", " sieben"), ("8", " acht"), ("9", " neun"),
]

# Unicode ranges of emoji. A symbol is a flag (two regional
# letters), a keycap, or a base with what modifies it (variation selector, skin
# tone, tags), joined to others by zero-width joiners; it counts as one.
EMOJI_BASE = (r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{231A}\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}"
              r"\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2194}-\x{2199}"
              r"\x{21A9}\x{21AA}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{203C}"
              r"\x{2049}\x{2122}\x{2139}\x{3030}\x{303D}\x{3297}\x{3299}\x{A9}\x{AE}]")
EMOJI_ELEMENT = rf"{EMOJI_BASE}\x{{FE0F}}?[\x{{1F3FB}}-\x{{1F3FF}}]?[\x{{E0020}}-\x{{E007F}}]*"
EMOJI = (rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]\x{{FE0F}}?\x{{20E3}}"
         rf"|{EMOJI_ELEMENT}(?:\x{{200D}}{EMOJI_ELEMENT})*")

# ASCII without digits, "#" and "*", the only ones an emoji may begin with.
NO_EMOJI_RUN = r"[\x00-\x22\x24-\x29\x2B-\x2F\x3A-\x7F]+"

# Address tokens counted after lower-casing.
USER_TOKEN = "@user"
MEDIUM_TOKEN = "@medium"

# Small default stop list used when no table is supplied (the full German list
# is a parameter: pass it as a list or a one-column table).
DEFAULT_STOPWORDS = ["und", "der", "das", "ist", "nicht", "so"]


# ---------------------------------------------------------------------------
# Building blocks
# ---------------------------------------------------------------------------
def tokens(text: Column) -> Column:
    """Python ``str.split()``: split on runs of whitespace, drop empty pieces."""
    return F.filter(F.split(text, WS_RUN), lambda x: x != F.lit(""))


def log_scale(x: Column) -> Column:
    """``ln(x + 1e-9)``."""
    return F.ln(x.cast("double") + F.lit(LOG_EPS))


def _token_lengths(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.length(t).cast("long"))


def _moments(toks: Column) -> Column:
    """One pass over token lengths carrying exact integer (n, sum, sum of squares)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"),
                    F.lit(0).cast("long").alias("ss"))
    return F.aggregate(
        _token_lengths(toks), zero,
        lambda acc, x: F.struct((acc["n"] + 1).alias("n"), (acc["s"] + x).alias("s"),
                                (acc["ss"] + x * x).alias("ss")))


# ---------------------------------------------------------------------------
# F1–F10
# ---------------------------------------------------------------------------
def num_characters(text: Column) -> Column:
    """ln(code points)."""
    return log_scale(F.length(text))


def num_words(text: Column) -> Column:
    """ln(#tokens)."""
    return log_scale(F.size(tokens(text)))


def average_word_length(text: Column) -> Column:
    """ln(mean token length); null for an empty token list."""
    m = _moments(tokens(text))
    return log_scale(F.try_divide(m["s"].cast("double"), m["n"].cast("double")))


def word_length_std(text: Column) -> Column:
    """ln(population std of token lengths), exact up to the final root."""
    m = _moments(tokens(text))
    var_n2 = m["n"] * m["ss"] - m["s"] * m["s"]  # n² · variance, exact in longs
    return log_scale(F.try_divide(F.sqrt(var_n2.cast("double")), m["n"].cast("double")))


def stopword_ratio(text: Column, stopwords: Iterable[str] | None = None) -> Column:
    """ln(stopword tokens / tokens) over lower-cased whitespace tokens.

    Membership is an ``isin`` over the literal list, which the optimizer turns
    into a hash-set lookup (``InSet``) for lists over ten words — constant time
    per token for a full stop-word list."""
    toks = tokens(F.lower(text))
    words = list(dict.fromkeys(DEFAULT_STOPWORDS if stopwords is None else stopwords))
    if words:
        hits = F.size(F.filter(toks, lambda t: t.isin(*words)))
    else:
        hits = F.lit(0)
    return log_scale(F.try_divide(hits.cast("double"), F.size(toks).cast("double")))


def exclamation_ratio(text: Column) -> Column:
    """count('!') / code points (not log-scaled)."""
    bangs = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    return F.try_divide(bangs.cast("double"), F.length(text).cast("double"))


def num_references(text: Column) -> Column:
    """ln(#matches of ``http*\\S+``), case-sensitive."""
    return log_scale(F.regexp_count(text, F.lit(REFERENCE_PATTERN)))


def _count_token(text: Column, token: str) -> Column:
    return F.size(F.filter(tokens(F.lower(text)), lambda t: t == F.lit(token)))


def num_user_addressed(text: Column) -> Column:
    """F8: ln(#tokens equal to ``@user`` after lower-casing)."""
    return log_scale(_count_token(text, USER_TOKEN))


def num_medium_addressed(text: Column) -> Column:
    """ln(#tokens equal to ``@medium`` after lower-casing)."""
    return log_scale(_count_token(text, MEDIUM_TOKEN))


def emoji_list(text: Column) -> Column:
    """Runs of ASCII that no emoji has become one blank first: the pattern tries its branches at every character."""
    return F.regexp_extract_all(F.regexp_replace(text, NO_EMOJI_RUN, " "), F.lit(EMOJI), F.lit(0))


def average_emoji_repetition(text: Column) -> Column:
    """ln(mean count per distinct emoji) = ln(total / distinct); 0 → ln(1e-9)."""
    # Bound to a lambda variable, so that the text is searched once.
    avg = F.transform(F.array(emoji_list(text)),
                      lambda e: F.try_divide(F.size(e).cast("double"), F.size(F.array_distinct(e)).cast("double")))[0]
    return log_scale(F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(avg, F.lit(0.0))))


# ---------------------------------------------------------------------------
# F2–F5, F8, F9 from the numbers of a text's words (``operators.words.word_numbers``)
# ---------------------------------------------------------------------------
def from_word_numbers(m: Column) -> dict[str, Column]:
    """The word features by name; the same as from the text."""
    n, var_n2 = m["n"].cast("double"), m["n"] * m["ss"] - m["s"] * m["s"]
    return {"NumWords": log_scale(m["n"]),
            "AverageWordLength": log_scale(F.try_divide(m["s"].cast("double"), n)),
            "WordLengthStandardDeviation": log_scale(F.try_divide(F.sqrt(var_n2.cast("double")), n)),
            "StopwordRatio": log_scale(F.try_divide(m["stop"].cast("double"), n)),
            "NumUserAdressed": log_scale(m["user"]),
            "NumMediumAdressed": log_scale(m["medium"])}


# ---------------------------------------------------------------------------
# F11 — cleaning for a downstream sentiment model
# ---------------------------------------------------------------------------
def clean_text(text: Column) -> Column:
    """newline→space, drop URLs and @mentions, spell digits, keep German
    letters and spaces, squeeze spaces, lower-case. Tabs and NBSP are deleted,
    joining the words around them (as the reference does)."""
    t = F.replace(text, F.lit("\n"), F.lit(" "))
    t = F.regexp_replace(t, CLEAN_URL_PATTERN, "")
    t = F.regexp_replace(t, CLEAN_MENTION_PATTERN, "")
    for digit, word in DIGIT_WORDS:
        t = F.replace(t, F.lit(digit), F.lit(word))
    # Keep-runs joined rather than a replace of the negated class: Java's regex
    # pays a failed match attempt at every kept character with the latter.
    t = F.array_join(F.regexp_extract_all(t, F.lit(CLEAN_KEEP_RUN), F.lit(0)), "")
    t = F.trim(F.regexp_replace(t, " +", " "))
    return F.lower(t)


# Raw (unscaled) helpers used by tests and by the issue-count feature.
def raw_token_count(text: Column) -> Column:
    return F.size(tokens(text))
