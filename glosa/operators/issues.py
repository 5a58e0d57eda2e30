"""Text-issue counts (G1) in 17 slots, ``ln(count) - ln(words)``.

The reference asks an external grammar checker for its matches and counts
them into slots by (category, rule id). Here the checker is replaced by a
rule table of regular expressions — ``regexp_count`` per rule is a column
expression, and the slot of a rule is known when the plan is built, so the
whole feature is one narrow projection (no join, no shuffle). Matches from
any external checker, as a table ``(comment_id, category, rule_id)``, go
through ``issue_counts_from_matches`` instead: a CASE expression maps each
match to its slot, a grouped pivot counts them (partial aggregation), and a
left join on the unique id gives clean comments zeros.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, TEXT
from glosa.functions.text import LOG_EPS, log_scale, raw_token_count

# ---------------------------------------------------------------------------
# Slot names, the checker categories and rule ids they take,
# in first-match order. Slots 15 and 16 can never fire, because the
# PUNCTUATION slot before them already takes those rules.
# ---------------------------------------------------------------------------
SLOT_NAMES = [
    "MISC", "RECOMMENDED_SPELLING", "TYPOGRAPHY", "PUNCTUATION", "GRAMMAR", "CASING",
    "SUPPORT_PUNCTUATION", "COLLOQUIALISMS", "COMPOUNDING", "CONFUSED_WORDS", "REDUNDANCY",
    "TYPOS", "STYLE", "PROPER_NOUNS", "IDIOMS", "DE_DOUBLE_PUNCTUATION", "DOUBLE_EXCLAMATION_MARK",
]
TYPOGRAPHY_EXCLUDED = ["TYPOGRAFISCHE_ANFUEHRUNGSZEICHEN", "FALSCHE_VERWENDUNG_DES_BINDESTRICHS",
                       "AKZENT_STATT_APOSTROPH", "MULTIPLICATION_SIGN"]
PUNCTUATION_EXCLUDED = ["EINHEIT_LEERZEICHEN", "ZEICHENSETZUNG_DIREKTE_REDE"]
# (slot, category, rule ids excluded, only this rule id)
SLOT_RULES = [
    (0, "MISC", None, None),
    (1, "EMPFOHLENE_RECHTSCHREIBUNG", None, None),
    (2, "TYPOGRAPHY", TYPOGRAPHY_EXCLUDED, None),
    (3, "PUNCTUATION", PUNCTUATION_EXCLUDED, None),
    (4, "GRAMMAR", None, None),
    (5, "CASING", None, None),
    (6, "HILFESTELLUNG_KOMMASETZUNG", None, None),
    (7, "COLLOQUIALISMS", None, None),
    (8, "COMPOUNDING", None, None),
    (9, "CONFUSED_WORDS", None, None),
    (10, "REDUNDANCY", None, None),
    (11, "TYPOS", None, None),
    (12, "STYLE", None, None),
    (13, "PROPER_NOUNS", None, None),
    (14, "IDIOMS", None, None),
    (15, "PUNCTUATION", None, "DE_DOUBLE_PUNCTUATION"),
    (16, "PUNCTUATION", None, "DOPPELTES_AUSRUFEZEICHEN"),
]

ISSUE_COLUMNS = [f"issue_{n.lower()}" for n in SLOT_NAMES]


@dataclass(frozen=True)
class IssueRule:
    rule_id: str
    category: str
    pattern: str  # Java/RE2-compatible: no look-around, back-references or \b
    # Each match holds one of these: a text without them is not searched. Empty: any text is.
    holds: tuple[str, ...] = ()


# Our default checker: simple surface rules that Java regex and RE2 agree on.
DEFAULT_RULES = [
    IssueRule("ELLIPSE_ZU_LANG", "MISC", r"[.][.][.][.]", ("....",)),
    IssueRule("ALTE_SCHREIBWEISE", "EMPFOHLENE_RECHTSCHREIBUNG", r"[Pp]hoto|[Tt]elephon|[Dd]elphin", ("hoto", "elephon", "elphin")),
    IssueRule("LEERZEICHEN_VOR_SATZZEICHEN", "TYPOGRAPHY", r" [,.!?;:]"),
    IssueRule("MEHRFACHE_LEERZEICHEN", "TYPOGRAPHY", r"  +", ("  ",)),
    IssueRule("TYPOGRAFISCHE_ANFUEHRUNGSZEICHEN", "TYPOGRAPHY", "\"", ('"',)),
    IssueRule("FALSCHE_VERWENDUNG_DES_BINDESTRICHS", "TYPOGRAPHY", r" - ", (" - ",)),
    IssueRule("DOPPELTES_AUSRUFEZEICHEN", "PUNCTUATION", r"!!", ("!!",)),
    IssueRule("DE_DOUBLE_PUNCTUATION", "PUNCTUATION", r"[,;:][.,;:]|[.][,;:]", tuple(a + b for a in ",;:." for b in ".,;:" if a + b != "..")),
    IssueRule("EINHEIT_LEERZEICHEN", "PUNCTUATION", r"[0-9](km|kg|cm|mm)"),
    IssueRule("FRAGEZEICHEN_HAEUFUNG", "PUNCTUATION", r"[?][?]", ("??",)),
    IssueRule("ARTIKEL_DOPPELT", "GRAMMAR", r"(der|die|das) (der|die|das) ", tuple(f"{a} {b} " for a in ("der", "die", "das") for b in ("der", "die", "das"))),
    IssueRule("KLEIN_NACH_SATZENDE", "CASING", r"[.!?] [a-zäöü]"),
    IssueRule("KOMMA_VOR_DASS", "HILFESTELLUNG_KOMMASETZUNG", r"[A-Za-zäöüß] dass ", (" dass ",)),
    IssueRule("UMGANGSSPRACHE", "COLLOQUIALISMS", r" (nen|nich|halt|mal) ", (" nen ", " nich ", " halt ", " mal ")),
    IssueRule("BINDESTRICH_LUECKE", "COMPOUNDING", r"[a-zäöüß]- [a-zäöüß]", ("- ",)),
    IssueRule("SEIT_SEID", "CONFUSED_WORDS", r"ihr seit |seid langem|seid gestern", ("ihr seit ", "seid langem", "seid gestern")),
    IssueRule("DOPPELT_GEMOPPELT", "REDUNDANCY", r"bereits schon|schon bereits|runter fallen", ("bereits schon", "schon bereits", "runter fallen")),
    IssueRule("GEDEHNTE_VOKALE", "TYPOS", r"aaa|eee|iii|ooo|uuu", ("aaa", "eee", "iii", "ooo", "uuu")),
    IssueRule("GROSSBUCHSTABEN", "STYLE", r"[A-ZÄÖÜ][A-ZÄÖÜ][A-ZÄÖÜ][A-ZÄÖÜ][A-ZÄÖÜ]"),
]


def slot_of(category: str, rule_id: str, specific_first: bool = False) -> int | None:
    """Slot for one match, first match wins (``specific_first`` checks the two
    rule-specific slots before the general PUNCTUATION slot)."""
    order = SLOT_RULES
    if specific_first:
        order = [r for r in SLOT_RULES if r[3]] + [r for r in SLOT_RULES if not r[3]]
    for slot, cat, excluded, only in order:
        if category != cat:
            continue
        if excluded and rule_id in excluded:
            continue
        if only and rule_id != only:
            continue
        return slot
    return None


def slot_expr(category: Column, rule_id: Column, specific_first: bool = False) -> Column:
    """The same first-match map as a CASE expression over a matches table."""
    order = SLOT_RULES
    if specific_first:
        order = [r for r in SLOT_RULES if r[3]] + [r for r in SLOT_RULES if not r[3]]
    out = None
    for slot, cat, excluded, only in order:
        cond = category == F.lit(cat)
        if excluded:
            cond = cond & ~rule_id.isin(excluded)
        if only:
            cond = cond & (rule_id == F.lit(only))
        out = F.when(cond, F.lit(slot)) if out is None else out.when(cond, F.lit(slot))
    return out


def _scale(count: Column, words: Column) -> Column:
    return log_scale(count) - F.ln(words.cast("double") + F.lit(LOG_EPS))


def rule_counts(text: Column, rules: Sequence[IssueRule] = DEFAULT_RULES) -> list[Column]:
    return [_counted(text, r) for r in rules]


def _counted(text: Column, rule: IssueRule) -> Column:
    found = F.regexp_count(text, F.lit(rule.pattern))
    if not rule.holds:
        return found
    held = functools.reduce(operator.or_, [F.contains(text, F.lit(h)) for h in rule.holds])
    return F.when(held, found).when(text.isNotNull(), F.lit(0))


def issue_columns(text: Column, rules: Sequence[IssueRule] = DEFAULT_RULES,
                  specific_first: bool = False, words: Column | None = None) -> list[Column]:
    """17 feature columns for one text column, from regex rules; ``words`` is its number of words, where it is known."""
    counts = rule_counts(text, rules)
    per_slot: dict[int, Column] = {}
    for rule, c in zip(rules, counts):
        s = slot_of(rule.category, rule.rule_id, specific_first)
        if s is not None:
            per_slot[s] = c if s not in per_slot else per_slot[s] + c
    words = raw_token_count(text) if words is None else words
    return [_scale(per_slot.get(i, F.lit(0)), words).alias(name) for i, name in enumerate(ISSUE_COLUMNS)]


def issue_counts(df: DataFrame, rules: Sequence[IssueRule] = DEFAULT_RULES, text_col: str = TEXT,
                 id_col: str = COMMENT_ID, specific_first: bool = False) -> DataFrame:
    return df.select(id_col, *issue_columns(F.col(text_col), rules, specific_first))


def rule_matches(df: DataFrame, rules: Sequence[IssueRule] = DEFAULT_RULES, text_col: str = TEXT,
                 id_col: str = COMMENT_ID) -> DataFrame:
    """Long match counts ``(id, category, rule_id, n)`` with n > 0 — the shape an
    external checker's output aggregates to."""
    items = [F.struct(F.lit(r.category).alias("category"), F.lit(r.rule_id).alias("rule_id"), c.alias("n"))
             for r, c in zip(rules, rule_counts(F.col(text_col), rules))]
    return (df.select(id_col, F.explode(F.array(*items)).alias("_m"))
            .select(id_col, "_m.category", "_m.rule_id", F.col("_m.n").cast("long").alias("n"))
            .where(F.col("n") > 0))


def issue_counts_from_matches(docs: DataFrame, matches: DataFrame, text_col: str = TEXT,
                              id_col: str = COMMENT_ID, specific_first: bool = False) -> DataFrame:
    """G1 over an external matches table ``(id, category, rule_id[, n])``."""
    n = F.col("n") if "n" in matches.columns else F.lit(1)
    counted = (matches.select(id_col, slot_expr(F.col("category"), F.col("rule_id"), specific_first).alias("slot"),
                              n.cast("long").alias("n"))
               .where(F.col("slot").isNotNull())
               .groupBy(id_col).pivot("slot", list(range(len(SLOT_NAMES)))).agg(F.sum("n")))
    words = docs.select(id_col, raw_token_count(F.col(text_col)).alias("_words"))
    joined = words.join(counted, id_col, "left")
    return joined.select(id_col, *[
        _scale(F.coalesce(F.col(f"`{i}`"), F.lit(0)), F.col("_words")).alias(name)
        for i, name in enumerate(ISSUE_COLUMNS)])
