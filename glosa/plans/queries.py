"""Registered queries: one Spark plan per operator plus its DuckDB oracle.

Every query reads the given tables (or tables Spark derives from them) in
full. Floats are rounded to 6 decimals on both sides so the comparison is
about values, not about summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, TEXT
from glosa.functions import text as tx
from glosa.plans import sql as S
from glosa.sources.comments import comments, spread

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(comments(spark, sf_dir))


# ---------------------------------------------------------------------------
# Scalar text features
# ---------------------------------------------------------------------------
_TOK = S.tokens_sql("c_text")
_TOK_LOWER = S.tokens_sql("lower(c_text)")
_LENS = f"list_transform({_TOK}, lambda x: length(x))"


FEATURE_SQL: dict[str, str] = {}


def _feature_query(name: str, out: str, expr: Callable[[Column], Column], sql_expr: str):
    FEATURE_SQL[name] = sql_expr
    sql = f"WITH {S.COMMENTS_CTE}\nSELECT comment_id, round(CAST({sql_expr} AS DOUBLE), 6) AS {out} FROM comments"

    @register(name, sql)
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _comments(spark, sf_dir).select(COMMENT_ID, r6(expr(F.col(TEXT))).alias(out))
    return q


_feature_query("f_num_characters", "num_characters", tx.num_characters, S.log_sql("length(c_text)"))
_feature_query("f_num_words", "num_words", tx.num_words, S.log_sql(f"len({_TOK})"))
_feature_query("f_avg_word_length", "avg_word_length", tx.average_word_length,
               S.log_sql(f"list_avg({_LENS})"))
_feature_query("f_word_length_std", "word_length_std", tx.word_length_std,
               S.log_sql(f"list_aggregate({_LENS}, 'stddev_pop')"))
_STOP_SQL = "['und', 'der', 'das', 'ist', 'nicht', 'so']"
_feature_query("f_stopword_ratio", "stopword_ratio", tx.stopword_ratio,
               S.log_sql(f"len(list_filter({_TOK_LOWER}, lambda x: list_contains({_STOP_SQL}, x)))"
                         f" / nullif(len({_TOK_LOWER}), 0)"))
_feature_query("f_exclamation_ratio", "exclamation_ratio", tx.exclamation_ratio,
               "(length(c_text) - length(replace(c_text, '!', ''))) / nullif(length(c_text), 0)")
_feature_query("f_num_references", "num_references", tx.num_references,
               S.log_sql(f"len(regexp_extract_all(c_text, 'http*{S.NON_WS}+'))"))
_feature_query("f_num_user_addressed", "num_user_addressed", tx.num_user_addressed,
               S.log_sql(f"len(list_filter({_TOK_LOWER}, lambda x: x = '@user'))"))
_feature_query("f_num_medium_addressed", "num_medium_addressed", tx.num_medium_addressed,
               S.log_sql(f"len(list_filter({_TOK_LOWER}, lambda x: x = '@medium'))"))
# Of the emoji, the test texts hold single ones of these planes only (see tests for sequences).
_EMO = r"regexp_extract_all(c_text, '[\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{2600}-\x{27BF}]')"
_feature_query("f_avg_emoji_repetition", "avg_emoji_repetition", tx.average_emoji_repetition,
               S.log_sql(f"coalesce(len({_EMO}) / nullif(len(list_distinct({_EMO})), 0), 0)"))


_CLEAN_SQL = "c_text"
_CLEAN_SQL = f"replace({_CLEAN_SQL}, chr(10), ' ')"
_CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, 'https*{S.NON_WS}+', '', 'g')"
_CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '@{S.NON_WS}+', '', 'g')"
for _d, _w in enumerate(" null, eins, zwei, drei, vier, fünf, sechs, sieben, acht, neun".split(",")):
    _CLEAN_SQL = f"replace({_CLEAN_SQL}, '{_d}', '{_w}')"
_CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '[^A-Za-züöäÖÜÄß ]', '', 'g')"
_CLEAN_SQL = f"lower(trim(regexp_replace({_CLEAN_SQL}, ' +', ' ', 'g')))"


@register("clean_text", f"WITH {S.COMMENTS_CTE}\nSELECT comment_id, {_CLEAN_SQL} AS cleaned FROM comments")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comments(spark, sf_dir).select(COMMENT_ID, tx.clean_text(F.col(TEXT)).alias("cleaned"))


# ---------------------------------------------------------------------------
# The comment table written as header CSV and read back
# ---------------------------------------------------------------------------
@register("comments_load", f"""WITH {S.COMMENTS_CTE}
SELECT CAST(comment_id AS VARCHAR) AS comment_id, nullif(c_text, '') AS c_text FROM comments""")
def q_comments_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV round trip: quotes and newlines survive; an empty field reads back as null."""
    from glosa.sources.comments import read_comments_csv, write_comments_csv
    path = write_comments_csv(_comments(spark, sf_dir))
    return read_comments_csv(spark, path, labelled=False)


# ---------------------------------------------------------------------------
# Label codes, stratified folds, class counts, fold splits
# ---------------------------------------------------------------------------
from glosa.columns import FOLD, LABELS, TASKS  # noqa: E402
from glosa.operators import ensemble as ens  # noqa: E402
from glosa.operators import evaluate as ev  # noqa: E402
from glosa.operators import folds as fo  # noqa: E402
from glosa.sources.comments import labelled  # noqa: E402
from glosa.sources.sinks import submission_frame  # noqa: E402

NUM_SPLITS, SEED = 7, 42
_CODE_SQL = ("'[' || CAST(Sub1_Toxic AS VARCHAR) || ' ' || CAST(Sub2_Engaging AS VARCHAR) || ' '"
             " || CAST(Sub3_FactClaiming AS VARCHAR) || ']'")
_FOLDS_CTE = S.LABELLED_CTE + f""",
coded AS (
  SELECT *, {_CODE_SQL} AS label_code, md5('{SEED}:' || CAST(comment_id AS VARCHAR)) AS h FROM labelled
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label_code ORDER BY h, comment_id) AS rn FROM coded
),
class_sizes AS (SELECT label_code, count(*) AS n FROM coded GROUP BY label_code),
class_starts AS (
  SELECT label_code,
         sum(n) OVER (ORDER BY label_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS start
  FROM class_sizes
),
folded AS (
  SELECT r.*, CAST((s.start + r.rn - 1) % {NUM_SPLITS} AS INT) AS fold
  FROM ranked r JOIN class_starts s USING (label_code)
)"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.assign_folds(labelled(spark, sf_dir), k=NUM_SPLITS, seed=SEED)


@register("multilabel_to_multiclass", f"""WITH {S.LABELLED_CTE},
coded AS (SELECT comment_id, {_CODE_SQL} AS label_code FROM labelled)
SELECT comment_id, label_code, CAST(dense_rank() OVER (ORDER BY label_code) - 1 AS INT) AS class_id FROM coded""")
def q_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.multilabel_to_multiclass(labelled(spark, sf_dir)).select(COMMENT_ID, fo.CODE, fo.CLASS_ID)


@register("stratified_folds", f"WITH {_FOLDS_CTE}\nSELECT comment_id, label_code, fold FROM folded")
def q_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select(COMMENT_ID, fo.CODE, FOLD)


@register("fold_table", f"WITH {_FOLDS_CTE}\nSELECT comment_id, label_code, fold FROM folded")
def q_fold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pre-folded corpus as a table by fold, each fold read back from its own partition."""
    import uuid
    from glosa.session import shared_dir
    folded = _folded(spark, sf_dir)
    path = f"{shared_dir(spark)}/folds-{uuid.uuid4().hex}"
    fo.write_folded(folded, path)
    table = fo.read_folded(spark, path, folded)
    out = fo.valid_rows(table, 0)
    for k in range(1, 7):
        out = out.unionAll(fo.valid_rows(table, k))
    return out.select(COMMENT_ID, fo.CODE, FOLD)


@register("class_distribution", f"""WITH {S.LABELLED_CTE}
SELECT {_CODE_SQL} AS label_code, count(*) AS n_rows FROM labelled GROUP BY 1""")
def q_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.class_distribution(labelled(spark, sf_dir).withColumn(fo.CODE, fo.label_code()))


@register("fold_class_counts", f"""WITH {_FOLDS_CTE}
SELECT fold, label_code, count(*) AS n_rows FROM folded GROUP BY fold, label_code""")
def q_fold_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.fold_class_counts(_folded(spark, sf_dir))


@register("fold_split_train", f"""WITH {_FOLDS_CTE}
SELECT c_text, Sub1_Toxic, Sub2_Engaging, Sub3_FactClaiming FROM folded WHERE fold IS DISTINCT FROM 0""")
def q_split_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.split_fold(_folded(spark, sf_dir), 0)[0].drop(fo.CODE)


@register("fold_split_dev", f"""WITH {_FOLDS_CTE}
SELECT c_text, Sub1_Toxic, Sub2_Engaging, Sub3_FactClaiming FROM folded WHERE fold = 0""")
def q_split_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.split_fold(_folded(spark, sf_dir), 0)[1].drop(fo.CODE)


# ---------------------------------------------------------------------------
# A1, A2, M6, M10, S6 on deterministic stand-in predictions
# pred(model i, task t, id) = 1 when (id*31 + i*i*17 + i*id*5 + t*7) % 10 < 5
# ---------------------------------------------------------------------------
def stand_in_pred(model: Column, task: int, ident: Column | None = None) -> Column:
    ident = (F.col(COMMENT_ID) if ident is None else ident).cast("long")
    model = model.cast("long")
    return ((ident * 31 + model * model * 17 + model * ident * 5 + task * 7) % 10 < 5).cast("int")


def _pred_sql(model: str, task: str, ident: str = "comment_id") -> str:
    return f"CASE WHEN ({ident}*31 + {model}*{model}*17 + {model}*{ident}*5 + {task}*7) % 10 < 5 THEN 1 ELSE 0 END"


_PRED_COLS = [f"pred_{i}" for i in range(3)]


def _oof_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions: each row is scored by the model of its own fold."""
    df = _folded(spark, sf_dir)
    df = df.select("*", *[stand_in_pred(F.col(FOLD), t).alias(p) for t, p in enumerate(_PRED_COLS)])
    return ev.to_long(df, _PRED_COLS)


_TASK_ROWS = " UNION ALL ".join(f"SELECT {i} AS t, '{name}' AS task, '{lab}' AS label_col"
                                for i, (name, lab) in enumerate(zip(TASKS, LABELS)))
_OOF_CTE = _FOLDS_CTE + f""",
tasks AS ({_TASK_ROWS}),
oof AS (
  SELECT f.comment_id, f.fold, k.task,
         CASE k.t WHEN 0 THEN f.Sub1_Toxic WHEN 1 THEN f.Sub2_Engaging ELSE f.Sub3_FactClaiming END AS label,
         {_pred_sql('f.fold', 'k.t', 'f.comment_id')} AS pred
  FROM folded f, tasks k
),
per_class AS (
  SELECT o.fold, o.task, c.cls,
         sum(CASE WHEN o.label = c.cls AND o.pred = c.cls THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN o.label <> c.cls AND o.pred = c.cls THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN o.label = c.cls AND o.pred <> c.cls THEN 1 ELSE 0 END) AS fn,
         max(CASE WHEN o.label = c.cls OR o.pred = c.cls THEN 1 ELSE 0 END) AS present
  FROM oof o, (SELECT 0 AS cls UNION ALL SELECT 1) c
  GROUP BY o.fold, o.task, c.cls
),
metrics AS (
  SELECT m.fold, m.task, a.accuracy,
         avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END) FILTER (WHERE present = 1) AS precision,
         avg(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END) FILTER (WHERE present = 1) AS recall,
         avg(CASE WHEN 2*tp + fp + fn = 0 THEN 0 ELSE 2*tp / (2*tp + fp + fn) END) FILTER (WHERE present = 1) AS f1
  FROM per_class m
  JOIN (SELECT fold, task, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM oof GROUP BY fold, task) a USING (fold, task)
  GROUP BY m.fold, m.task, a.accuracy
)"""


def _r6_all(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(F.col(c)).alias(c) for c in df.columns if c not in keys])


@register("task_metrics", f"""WITH {_OOF_CTE}
SELECT fold, task, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM metrics""")
def q_task_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r6_all(ev.task_metrics(_oof_long(spark, sf_dir)), [FOLD, "task"])


@register("metrics_summary", f"""WITH {_OOF_CTE}
SELECT task,
       round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std,
       round(avg(precision), 6) AS precision_mean, round(stddev_pop(precision), 6) AS precision_std,
       round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std,
       round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std
FROM metrics GROUP BY task""")
def q_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r6_all(ev.metrics_summary(ev.task_metrics(_oof_long(spark, sf_dir))), ["task"])


@register("multilabel_macro_f1", f"""WITH {_OOF_CTE},
pos AS (
  SELECT fold, task,
         sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn
  FROM oof GROUP BY fold, task
)
SELECT fold, round(avg(CASE WHEN 2*tp + fp + fn = 0 THEN 0 ELSE 2*tp / (2*tp + fp + fn) END), 6) AS macro_f1
FROM pos GROUP BY fold""")
def q_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r6_all(ev.multilabel_macro_f1(_oof_long(spark, sf_dir)), [FOLD])


def _vote_sql(n_models: int, with_text: bool = False) -> str:
    text = "c.c_text, " if with_text else ""
    return f"""WITH {S.COMMENTS_CTE},
p AS (
  SELECT comment_id, t, {_pred_sql('i', 't')} AS pred
  FROM comments, range(0, {n_models}) r(i), range(0, 3) s(t)
),
v AS (SELECT comment_id, t, CAST(2 * sum(pred) >= count(*) AS INT) AS vote FROM p GROUP BY comment_id, t)
SELECT c.comment_id, {text}
       max(CASE WHEN t = 0 THEN vote END) AS Sub1_Toxic,
       max(CASE WHEN t = 1 THEN vote END) AS Sub2_Engaging,
       max(CASE WHEN t = 2 THEN vote END) AS Sub3_FactClaiming
FROM comments c JOIN v USING (comment_id) GROUP BY ALL"""


def _voted(spark: SparkSession, sf_dir: str, n_models: int) -> DataFrame:
    """Every fold model scores the same test rows, so the vote is in-row."""
    c = _comments(spark, sf_dir)
    return c.select(COMMENT_ID, TEXT, *[
        ens.vote([stand_in_pred(F.lit(i), t) for i in range(n_models)]).alias(lab)
        for t, lab in enumerate(LABELS)])


@register("ensemble_vote", _vote_sql(7))
def q_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir, 7).drop(TEXT)


@register("ensemble_vote_tie", _vote_sql(6))
def q_vote_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir, 6).drop(TEXT)


@register("ensemble_vote_long", f"""WITH {S.COMMENTS_CTE}, tasks AS ({_TASK_ROWS}),
p AS (SELECT comment_id, k.task, {_pred_sql('i', 'k.t')} AS pred FROM comments, range(0, 7) r(i), tasks k)
SELECT comment_id, task, CAST(2 * sum(pred) >= count(*) AS INT) AS vote FROM p GROUP BY comment_id, task""")
def q_vote_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _comments(spark, sf_dir).select(COMMENT_ID, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("model"))
    preds = c.select(COMMENT_ID, "model", F.explode(F.array(*[
        F.struct(F.lit(name).alias("task"), stand_in_pred(F.col("model"), t).alias("pred"))
        for t, name in enumerate(TASKS)])).alias("_p")).select(COMMENT_ID, "model", "_p.task", "_p.pred")
    return ens.vote_long(preds)


@register("submission", _vote_sql(7, with_text=True))
def q_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission_frame(_voted(spark, sf_dir, 7), with_text=True)


# ---------------------------------------------------------------------------
# G1: text-issue counts (regex rules and the external-matches path)
# ---------------------------------------------------------------------------
from glosa.operators import issues as iss  # noqa: E402

# Written out, not taken from the operator's rule table.
_RULE_ROWS = r"""
    SELECT comment_id, 'MISC' AS category, 'ELLIPSE_ZU_LANG' AS rule_id,
           len(regexp_extract_all(c_text, '[.][.][.][.]')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'EMPFOHLENE_RECHTSCHREIBUNG' AS category, 'ALTE_SCHREIBWEISE' AS rule_id,
           len(regexp_extract_all(c_text, '[Pp]hoto|[Tt]elephon|[Dd]elphin')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'TYPOGRAPHY' AS category, 'LEERZEICHEN_VOR_SATZZEICHEN' AS rule_id,
           len(regexp_extract_all(c_text, ' [,.!?;:]')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'TYPOGRAPHY' AS category, 'MEHRFACHE_LEERZEICHEN' AS rule_id,
           len(regexp_extract_all(c_text, '  +')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'TYPOGRAPHY' AS category, 'TYPOGRAFISCHE_ANFUEHRUNGSZEICHEN' AS rule_id,
           len(regexp_extract_all(c_text, '"')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'TYPOGRAPHY' AS category, 'FALSCHE_VERWENDUNG_DES_BINDESTRICHS' AS rule_id,
           len(regexp_extract_all(c_text, ' - ')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'PUNCTUATION' AS category, 'DOPPELTES_AUSRUFEZEICHEN' AS rule_id,
           len(regexp_extract_all(c_text, '!!')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'PUNCTUATION' AS category, 'DE_DOUBLE_PUNCTUATION' AS rule_id,
           len(regexp_extract_all(c_text, '[,;:][.,;:]|[.][,;:]')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'PUNCTUATION' AS category, 'EINHEIT_LEERZEICHEN' AS rule_id,
           len(regexp_extract_all(c_text, '[0-9](km|kg|cm|mm)')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'PUNCTUATION' AS category, 'FRAGEZEICHEN_HAEUFUNG' AS rule_id,
           len(regexp_extract_all(c_text, '[?][?]')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'GRAMMAR' AS category, 'ARTIKEL_DOPPELT' AS rule_id,
           len(regexp_extract_all(c_text, '(der|die|das) (der|die|das) ')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'CASING' AS category, 'KLEIN_NACH_SATZENDE' AS rule_id,
           len(regexp_extract_all(c_text, '[.!?] [a-zäöü]')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'HILFESTELLUNG_KOMMASETZUNG' AS category, 'KOMMA_VOR_DASS' AS rule_id,
           len(regexp_extract_all(c_text, '[A-Za-zäöüß] dass ')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'COLLOQUIALISMS' AS category, 'UMGANGSSPRACHE' AS rule_id,
           len(regexp_extract_all(c_text, ' (nen|nich|halt|mal) ')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'COMPOUNDING' AS category, 'BINDESTRICH_LUECKE' AS rule_id,
           len(regexp_extract_all(c_text, '[a-zäöüß]- [a-zäöüß]')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'CONFUSED_WORDS' AS category, 'SEIT_SEID' AS rule_id,
           len(regexp_extract_all(c_text, 'ihr seit |seid langem|seid gestern')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'REDUNDANCY' AS category, 'DOPPELT_GEMOPPELT' AS rule_id,
           len(regexp_extract_all(c_text, 'bereits schon|schon bereits|runter fallen')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'TYPOS' AS category, 'GEDEHNTE_VOKALE' AS rule_id,
           len(regexp_extract_all(c_text, 'aaa|eee|iii|ooo|uuu')) AS n FROM comments
    UNION ALL
    SELECT comment_id, 'STYLE' AS category, 'GROSSBUCHSTABEN' AS rule_id,
           len(regexp_extract_all(c_text, '[A-ZÄÖÜ][A-ZÄÖÜ][A-ZÄÖÜ][A-ZÄÖÜ][A-ZÄÖÜ]')) AS n FROM comments"""
_SLOT_CASE = """CASE
  WHEN category = 'MISC' THEN 0
  WHEN category = 'EMPFOHLENE_RECHTSCHREIBUNG' THEN 1
  WHEN category = 'TYPOGRAPHY' AND rule_id NOT IN ('TYPOGRAFISCHE_ANFUEHRUNGSZEICHEN',
       'FALSCHE_VERWENDUNG_DES_BINDESTRICHS', 'AKZENT_STATT_APOSTROPH', 'MULTIPLICATION_SIGN') THEN 2
  WHEN category = 'PUNCTUATION' AND rule_id NOT IN ('EINHEIT_LEERZEICHEN', 'ZEICHENSETZUNG_DIREKTE_REDE') THEN 3
  WHEN category = 'GRAMMAR' THEN 4
  WHEN category = 'CASING' THEN 5
  WHEN category = 'HILFESTELLUNG_KOMMASETZUNG' THEN 6
  WHEN category = 'COLLOQUIALISMS' THEN 7
  WHEN category = 'COMPOUNDING' THEN 8
  WHEN category = 'CONFUSED_WORDS' THEN 9
  WHEN category = 'REDUNDANCY' THEN 10
  WHEN category = 'TYPOS' THEN 11
  WHEN category = 'STYLE' THEN 12
  WHEN category = 'PROPER_NOUNS' THEN 13
  WHEN category = 'IDIOMS' THEN 14
  WHEN category = 'PUNCTUATION' AND rule_id = 'DE_DOUBLE_PUNCTUATION' THEN 15
  WHEN category = 'PUNCTUATION' AND rule_id = 'DOPPELTES_AUSRUFEZEICHEN' THEN 16
END"""
_ISSUE_MATCHES_CTE = f"""{S.COMMENTS_CTE},
matches AS ({_RULE_ROWS}),
slotted AS (SELECT comment_id, {_SLOT_CASE} AS slot, n FROM matches)"""
_ISSUE_SELECT = ",\n  ".join(
    f"round(ln(CAST(coalesce(sum(CASE WHEN s.slot = {i} THEN s.n END), 0) AS DOUBLE) + 1e-9)"
    f" - ln(CAST(len({S.tokens_sql('c.c_text')}) AS DOUBLE) + 1e-9), 6) AS {name}"
    for i, name in enumerate(iss.ISSUE_COLUMNS))
_ISSUE_SQL = f"""WITH {_ISSUE_MATCHES_CTE}
SELECT c.comment_id,
  {_ISSUE_SELECT}
FROM comments c LEFT JOIN slotted s ON s.comment_id = c.comment_id
GROUP BY c.comment_id, c.c_text"""


def _r6_features(df: DataFrame, key: str = COMMENT_ID) -> DataFrame:
    return df.select(key, *[r6(F.col(c)).alias(c) for c in df.columns if c != key])


@register("issue_counts", _ISSUE_SQL)
def q_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r6_features(iss.issue_counts(_comments(spark, sf_dir)))


@register("issue_counts_from_matches", _ISSUE_SQL)
def q_issue_counts_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _comments(spark, sf_dir)
    return _r6_features(iss.issue_counts_from_matches(c, iss.rule_matches(c)))


@register("issue_slot_totals", f"""WITH {_ISSUE_MATCHES_CTE}
SELECT slot, CAST(sum(n) AS BIGINT) AS n_matches FROM slotted WHERE n > 0 AND slot IS NOT NULL GROUP BY slot""")
def q_issue_slot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = iss.rule_matches(_comments(spark, sf_dir))
    return (m.select(iss.slot_expr(F.col("category"), F.col("rule_id")).alias("slot"), "n")
            .where(F.col("slot").isNotNull())
            .groupBy("slot").agg(F.sum("n").cast("long").alias("n_matches")))


@register("issue_category_map", f"""WITH {_ISSUE_MATCHES_CTE}
SELECT DISTINCT category, rule_id, {_SLOT_CASE} AS slot FROM matches WHERE n > 0""")
def q_issue_category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot each matched (category, rule) lands in; null = not counted."""
    m = iss.rule_matches(_comments(spark, sf_dir))
    return (m.select("category", "rule_id").distinct()
            .select("category", "rule_id", iss.slot_expr(F.col("category"), F.col("rule_id")).alias("slot")))


# ---------------------------------------------------------------------------
# Pooled word vectors and lexicon polarity (derived lookup tables)
# ---------------------------------------------------------------------------
from glosa.operators import attention as att  # noqa: E402
from glosa.operators import lookups as lk  # noqa: E402
from glosa.operators import windows as win  # noqa: E402
from glosa.sources import lookups as lt  # noqa: E402
from glosa.sources.comments import load_table  # noqa: E402

_LTOKS_CTE = f"""{S.COMMENTS_CTE},
toks AS (SELECT comment_id, unnest({_TOK_LOWER}) AS token FROM comments),
ntok AS (SELECT comment_id, len({_TOK_LOWER}) AS n FROM comments)"""


WORD_VECTOR_DIM = 300


@register("pooled_word_vectors", f"""WITH {_LTOKS_CTE},
kinds AS (
  SELECT comment_id, length(token) AS l, instr(token, 'e') AS e, count(*) AS n FROM toks WHERE length(token) >= 3 GROUP BY ALL
),
sums AS (
  SELECT comment_id, dim, sum(((l * (dim + 1) + e) % 13 - 6) * n) AS s
  FROM kinds, (SELECT unnest(range(0, {WORD_VECTOR_DIM})) AS dim) GROUP BY comment_id, dim
)
SELECT n.comment_id, CAST(d.dim AS INT) AS dim, round(coalesce(CAST(s.s AS DOUBLE) / nullif(n.n, 0), 0), 6) AS value
FROM ntok n CROSS JOIN (SELECT unnest(range(0, {WORD_VECTOR_DIM})) AS dim) d
LEFT JOIN sums s ON s.comment_id = n.comment_id AND s.dim = d.dim""")
def q_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _comments(spark, sf_dir)
    pooled = lk.pooled_word_vectors(c, lt.derived_wide_vectors(c, WORD_VECTOR_DIM), dim=WORD_VECTOR_DIM)
    return pooled.select(COMMENT_ID, F.posexplode("pooled").alias("dim", "value")).withColumn("value", r6(F.col("value")))


@register("lexicon_polarity", f"""WITH {_LTOKS_CTE},
lex AS (SELECT DISTINCT token FROM toks WHERE length(token) >= 4),
hits AS (
  SELECT t.comment_id, avg((length(l.token) % 5 - 2) / 2.0) AS p
  FROM toks t JOIN lex l ON l.token = t.token GROUP BY t.comment_id
)
SELECT c.comment_id, round(coalesce(h.p, 0), 6) AS polarity
FROM comments c LEFT JOIN hits h ON h.comment_id = c.comment_id""")
def q_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _comments(spark, sf_dir)
    return lk.lexicon_polarity(c, lt.derived_polarity(c)).withColumn("polarity", r6(F.col("polarity")))


# ---------------------------------------------------------------------------
# Token windows, vocabulary and character encoding, token re-join
# ---------------------------------------------------------------------------
# Style-model window shape (parameters of the model; ours). All windows, whole
# tokens and the full vocabulary.
WINDOW_TOKENS, HOP = 25, 20

_WIN_CTE = f"""{S.COMMENTS_CTE},
toks AS (SELECT comment_id, {_TOK} AS tk FROM comments),
w AS (
  SELECT comment_id, start // {HOP} AS window_idx, tk[start + 1 : start + {WINDOW_TOKENS}] AS wt
  FROM (SELECT comment_id, tk, unnest(range(0, len(tk), {HOP})) AS start FROM toks)
)"""
_WIN_TOK_CTE = f"""{_WIN_CTE},
wtok AS (
  SELECT comment_id, window_idx, unnest(wt) AS token, unnest(range(0, len(wt))) AS pos
  FROM w
)"""


@register("token_windows", f"""WITH {_WIN_CTE}
SELECT comment_id, CAST(window_idx AS INT) AS window_idx, array_to_string(wt, ' ') AS window FROM w""")
def q_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.token_windows(_comments(spark, sf_dir), WINDOW_TOKENS, HOP).select(COMMENT_ID, "window_idx", "window")


@register("window_lengths", f"""WITH {_WIN_CTE}
SELECT comment_id, CAST(window_idx AS INT) AS window_idx, CAST(len(wt) AS INT) AS n_words,
       CAST(count(*) OVER (PARTITION BY comment_id) AS INT) AS n_windows
FROM w""")
def q_window_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.window_lengths(_comments(spark, sf_dir), WINDOW_TOKENS, HOP)


@register("vocab_encode", f"""WITH {_WIN_TOK_CTE},
freq AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOK_LOWER}) AS token FROM comments) GROUP BY token),
vocab AS (
  SELECT token, CAST(rn + 1 AS INT) AS id
  FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rn FROM freq)
)
SELECT t.comment_id, CAST(t.window_idx AS INT) AS window_idx, CAST(t.pos AS INT) AS pos, t.token,
       coalesce(v.id, 1) AS word_id
FROM wtok t LEFT JOIN vocab v ON v.token = t.token""")
def q_vocab_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _comments(spark, sf_dir)
    return lk.vocab_encode(c, lt.derived_word_vocab(c), WINDOW_TOKENS, HOP)


@register("char_encode", f"""WITH {_WIN_TOK_CTE}
SELECT comment_id, CAST(window_idx AS INT) AS window_idx, CAST(pos AS INT) AS pos,
       array_to_string(list_transform(regexp_extract_all(token, '.'),
         lambda ch: CASE WHEN ch >= 'a' AND ch <= 'z' THEN ascii(ch) - 95 ELSE 1 END), ',') AS char_ids
FROM wtok""")
def q_char_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = lk.char_encode(_comments(spark, sf_dir), lt.derived_char_vocab(spark), WINDOW_TOKENS, HOP)
    return enc.select(COMMENT_ID, "window_idx", "pos",
                      F.concat_ws(",", F.col("char_ids").cast("array<string>")).alias("char_ids"))


@register("join_tokens", f"""WITH {S.COMMENTS_CTE}
SELECT comment_id,
       trim(array_to_string(flatten(list_transform(string_split(c_text, chr(10)),
            lambda s: {S.tokens_sql('s')})), ' ')) AS joined
FROM comments""")
def q_join_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comments(spark, sf_dir).select(
        COMMENT_ID, win.join_tokens(win.sentences_by_line(F.col(TEXT))).alias("joined"))


# ---------------------------------------------------------------------------
# Softmax pooling; G3: document-vector attach
# ---------------------------------------------------------------------------
@register("softmax_pool", """WITH e AS (
  SELECT label, CAST(embedding[1] AS DOUBLE) AS s, embedding FROM embeddings
),
m AS (SELECT label, max(s) AS mx FROM e GROUP BY label),
x AS (
  SELECT e.label, exp(e.s - m.mx) AS w, unnest(e.embedding) AS v, unnest(range(0, len(e.embedding))) AS dim
  FROM e JOIN m ON m.label = e.label
)
SELECT label, CAST(dim AS INT) AS dim, round(sum(w * v) / sum(w), 6) AS value FROM x GROUP BY label, dim""")
def q_softmax_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "embeddings")
    items = e.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("score"),
                     F.col("embedding").cast("array<double>").alias("vector"))
    pooled = att.softmax_pool(items, "label", "score", "vector")
    return pooled.select("label", F.posexplode("pooled").alias("dim", "value")).withColumn("value", r6(F.col("value")))


ATTENTION_CONTEXT = [0.05, -0.1, 0.2]


@register("attention_two_level", f"""WITH {_WIN_TOK_CTE},
x AS (
  SELECT comment_id, window_idx, (length(token) % 7) / 2.0 AS s, length(token) AS v0, length(token) % 3 AS v1, instr(token, 'e') AS v2 FROM wtok
),
m AS (SELECT comment_id, window_idx, max(s) AS mx FROM x GROUP BY ALL),
pw AS (
  SELECT comment_id, window_idx, sum(exp(s - mx) * v0) / sum(exp(s - mx)) AS v0, sum(exp(s - mx) * v1) / sum(exp(s - mx)) AS v1,
         sum(exp(s - mx) * v2) / sum(exp(s - mx)) AS v2
  FROM x JOIN m USING (comment_id, window_idx) GROUP BY ALL
),
ws AS (SELECT *, {ATTENTION_CONTEXT[0]} * v0 + ({ATTENTION_CONTEXT[1]}) * v1 + {ATTENTION_CONTEXT[2]} * v2 AS s FROM pw),
wm AS (SELECT comment_id, max(s) AS mx FROM ws GROUP BY comment_id),
d AS (
  SELECT comment_id, sum(exp(s - mx)) AS z, sum(exp(s - mx) * v0) AS v0, sum(exp(s - mx) * v1) AS v1, sum(exp(s - mx) * v2) AS v2
  FROM ws JOIN wm USING (comment_id) GROUP BY comment_id
)
SELECT comment_id, CAST(dim AS INT) AS dim, round(CASE dim WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END / z, 6) AS value
FROM d, (SELECT unnest([0, 1, 2]) AS dim)""")
def q_attention_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to window vectors to document vectors; scores and vectors are derived from the words."""
    rows = lk.window_token_rows(_comments(spark, sf_dir), WINDOW_TOKENS, HOP, None)
    n = F.length("token")
    items = rows.select(COMMENT_ID, "window_idx", ((n % 7) / 2.0).alias("score"),
                        F.array(n.cast("double"), (n % 3).cast("double"), F.instr("token", "e").cast("double")).alias("vector"))
    pooled = att.attention_two_level(items, COMMENT_ID, "window_idx", "score", "vector", ATTENTION_CONTEXT)
    return pooled.select(COMMENT_ID, F.posexplode("pooled").alias("dim", "value")).withColumn("value", r6(F.col("value")))


@register("attach_embeddings", f"""WITH {S.COMMENTS_CTE},
hit AS (
  SELECT c.comment_id, unnest(range(0, len(e.embedding))) AS dim, unnest(e.embedding) AS v
  FROM comments c JOIN embeddings e ON e.vec_id = c.comment_id
)
SELECT comment_id, CAST(dim AS INT) AS dim, round(CAST(v AS DOUBLE), 6) AS value FROM hit
UNION ALL
SELECT comment_id, NULL, NULL FROM comments c
WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.comment_id)""")
def q_attach_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glosa.operators.scoring import attach_vectors
    c = _comments(spark, sf_dir)
    vecs = lt.doc_vectors_from_embeddings(load_table(spark, sf_dir, "embeddings"))
    att_df = attach_vectors(c, vecs, "vector")
    return att_df.select(COMMENT_ID, F.posexplode_outer("vector").alias("dim", "value")).withColumn(
        "value", r6(F.col("value")))


# ---------------------------------------------------------------------------
# M1, M2: population scaler, SVD projection and its second-moment matrix
# ---------------------------------------------------------------------------
from pyspark.ml.feature import VectorAssembler, VectorSlicer  # noqa: E402
from pyspark.ml.functions import array_to_vector, vector_to_array  # noqa: E402

from glosa.functions import registry as reg  # noqa: E402
from glosa.operators import linalg as la  # noqa: E402

_STD_CTE = """x AS (
  SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS dim FROM embeddings
),
s AS (SELECT dim, avg(CAST(v AS DOUBLE)) AS mu, stddev_pop(CAST(v AS DOUBLE)) AS sd FROM x GROUP BY dim),
z AS (
  SELECT vec_id, dim, CASE WHEN sd > 0 THEN (CAST(v AS DOUBLE) - mu) / sd ELSE CAST(v AS DOUBLE) - mu END AS z
  FROM x JOIN s USING (dim)
)"""


def _standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return la.fit_population_scaler(e, "v", "z").transform(e).select("vec_id", vector_to_array("z").alias("z"))


@register("standardize_embeddings", f"""WITH {_STD_CTE}
SELECT vec_id, CAST(dim AS INT) AS dim, round(z, 6) AS value FROM z""")
def q_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standardized(spark, sf_dir).select("vec_id", F.posexplode("z").alias("dim", "value")).withColumn(
        "value", r6(F.col("value")))


@register("svd_gram", f"""WITH {_STD_CTE}
SELECT CAST(a.dim AS INT) AS i, CAST(b.dim AS INT) AS j, round(sum(a.z * b.z) / count(*), 6) AS value
FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY a.dim, b.dim""")
def q_svd_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _standardized(spark, sf_dir)
    dim = len(z.select("z").first()[0])
    return la.gram(z, "z", dim).withColumn("value", r6(F.col("value")))


SVD_K = 8


@register("svd_project")
def q_svd_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: singular vectors are defined up to sign."""
    e = load_table(spark, sf_dir, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    z = la.fit_population_scaler(e, "v", "z").transform(e)
    p = la.fit_svd(z, "z", "p", SVD_K).transform(z)
    return p.select("vec_id", F.posexplode(vector_to_array("p")).alias("component", "value"))


@register("svd_row_norms", f"""WITH {_STD_CTE}
SELECT vec_id, round(sum(z * z), 6) AS value FROM z GROUP BY vec_id""")
def q_svd_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free of signs: on all components, a row's squared norm is that of the standardised row."""
    e = load_table(spark, sf_dir, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    z = la.fit_population_scaler(e, "v", "z").transform(e)
    dim = len(z.select("z").first()[0])
    p = la.fit_svd(z, "z", "p", dim).transform(z).select("vec_id", vector_to_array("p").alias("p"))
    return p.select("vec_id", r6(F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x)).alias("value"))


@register("svd_components", """WITH d AS (SELECT len(embedding) AS n FROM embeddings LIMIT 1)
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, true AS holds
FROM (SELECT unnest(range(0, n)) AS i FROM d), (SELECT unnest(range(0, n)) AS j FROM d)""")
def q_svd_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only the singular vectors in order give: components are uncorrelated, their energies do not rise,
    and together they have the energy of the standardised block (the last one's row)."""
    e = load_table(spark, sf_dir, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    z = la.fit_population_scaler(e, "v", "z").transform(e)
    dim = len(z.select(vector_to_array("z")).first()[0])
    p = la.fit_svd(z, "z", "p", dim).transform(z).select(vector_to_array("p").alias("p"))
    g = la.gram(p, "p", dim)
    energies = [r.value for r in g.where("i = j").orderBy("i").select("value").collect()]  # as many as dimensions
    before = F.get(F.array(*[F.lit(float(v)) for v in energies]), F.col("i") - 1)
    order = (F.col("i") == 0) | (before >= F.col("value") - 1e-9)
    whole = (F.col("i") < dim - 1) | F.lit(abs(sum(energies) - dim) < 1e-6)
    return g.select("i", "j", F.when(F.col("i") == F.col("j"), order & whole).otherwise(
        F.abs("value") < 1e-8).alias("holds"))


@register("fold_statistics", """WITH x AS (
  SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings
),
f AS (SELECT DISTINCT label AS fold FROM embeddings WHERE label IS NOT NULL),
m AS (SELECT fold, i, avg(v) AS mean, count(*) AS n FROM f JOIN x ON x.label <> f.fold GROUP BY fold, i)
SELECT CAST(f.fold AS INT) AS fold, m.n, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(m.mean, 6) AS mean,
       round(covar_pop(a.v, b.v), 6) AS value
FROM f JOIN x a ON a.label <> f.fold JOIN x b ON b.vec_id = a.vec_id JOIN m ON m.fold = f.fold AND m.i = a.i
GROUP BY f.fold, m.n, a.i, b.i, m.mean""")
def q_fold_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1/M2: means and covariances of every training fold (a label's rows left out) from one scan."""
    from glosa.operators.moments import fold_sums, moment_table
    e = load_table(spark, sf_dir, "embeddings").where("label is not null")
    sums = fold_sums(e, F.col("embedding").cast("array<double>"), F.col("label"))
    out = moment_table(sums, sorted(sums.sums), spark)
    return out.withColumn("mean", r6(F.col("mean"))).withColumn("value", r6(F.col("value")))


L1_C, L1_K, L1_SLACK = (0.2, 5.0), 24, 1e-3


@register("l1_optimality", f"""SELECT CAST(t AS INT) AS task, CAST(c AS DOUBLE) AS c, CAST(i AS INT) AS idx, true AS satisfied
FROM (SELECT unnest(range(0, 2)) AS t), (SELECT unnest({list(L1_C)}) AS c), (SELECT unnest(range(0, {L1_K} + 1)) AS i)""")
def q_l1_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 on the search's own path: scaled components, both penalties and both tasks in one search.

    By the definition of C, C · Σ loss + |w|₁ is least where C times the summed gradient is
    minus the sign of a non-zero coefficient, within [-1, 1] for a zero one and 0 for the
    intercept (the last index). The gradients are summed by Spark over the scaled rows."""
    from glosa.functions.registry import FeatureLayout
    from glosa.operators.tuning import fit_model
    e = load_table(spark, sf_dir, "embeddings").where("label is not null")
    e = e.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("emb"), (F.col("label") % 2).alias("y0"),
                 (F.col("label") > 4).cast("int").alias("y1"))
    dim = len(e.select(vector_to_array("emb")).first()[0])
    layout = FeatureLayout([], [("emb", dim)], [f"e{i}" for i in range(dim)], ["embedding"] * dim)
    out = None
    for c in L1_C:
        m = fit_model(e, layout, L1_K, c, ["y0", "y1"], max_iter=5000, tol=1e-9)
        x = m.shared.model.transform(e).select(F.slice(vector_to_array(m.shared.output), 1, L1_K).alias("x"), "y0", "y1")
        for t, r in enumerate(m.regressions):
            w = r.coefficients.toArray().tolist()
            dot = F.aggregate(F.zip_with("x", F.array(*[F.lit(v) for v in w]), lambda a, v: a * v), F.lit(float(r.intercept)),
                              lambda a, v: a + v)
            off = x.select((1 / (1 + F.exp(-dot)) - F.col(f"y{t}")).alias("r"),
                           F.posexplode(F.concat("x", F.array(F.lit(1.0)))).alias("idx", "v"))
            grad = off.groupBy("idx").agg((c * F.sum(F.col("r") * F.col("v"))).alias("g"))
            own = F.element_at(F.array(*[F.lit(v) for v in [*w, 0.0]]), F.col("idx") + 1)
            ok = F.when(F.col("idx") == len(w), F.abs("g") < L1_SLACK).when(
                own != 0, F.abs(F.col("g") + F.signum(own)) < L1_SLACK).otherwise(
                    F.abs("g") <= 1 + L1_SLACK)
            part = grad.select(F.lit(t).alias("task"), F.lit(float(c)).alias("c"), "idx", ok.alias("satisfied"))
            out = part if out is None else out.unionAll(part)
    return out


# ---------------------------------------------------------------------------
# Feature-set projection, block assembly and block selection
# ---------------------------------------------------------------------------
_SET = ["NumWords", "NumCharacters", "ExclamationMarkRatio", "NumReferences"]
_SET_SQL = {"NumWords": "f_num_words", "NumCharacters": "f_num_characters",
            "ExclamationMarkRatio": "f_exclamation_ratio", "NumReferences": "f_num_references"}


@register("feature_set_select", f"""WITH {S.COMMENTS_CTE}
SELECT comment_id, """ + ", ".join(f"round(CAST({FEATURE_SQL[_SET_SQL[n]]} AS DOUBLE), 6) AS f_{n}" for n in _SET)
          + " FROM comments")
def q_feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats, layout = reg.build_features(_comments(spark, sf_dir), _SET)
    return feats.select(COMMENT_ID, *[r6(F.col(c)).alias(c) for c in layout.numerical])


@register("text_pipeline", f"""WITH {S.COMMENTS_CTE},
f AS (SELECT comment_id, """ + ", ".join(f"CAST({FEATURE_SQL[_SET_SQL[n]]} AS DOUBLE) AS v{i}" for i, n in enumerate(_SET)) + """ FROM comments)
""" + " UNION ALL ".join(f"SELECT comment_id, {i} AS idx, round(coalesce(v{i}, 0), 6) AS value FROM f" for i in range(len(_SET))))
def q_text_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through a saved and loaded pipeline that begins with our own transformer."""
    import uuid
    from pyspark.ml import PipelineModel
    from glosa.session import shared_dir
    path = f"{shared_dir(spark)}/text-pipeline-{uuid.uuid4().hex}"
    PipelineModel(stages=[reg.TextFeatures(features=_SET)]).write().save(path)
    out = PipelineModel.load(path).transform(_comments(spark, sf_dir))
    return out.select(COMMENT_ID, F.posexplode(vector_to_array("num")).alias("idx", "value")).withColumn("value", r6(F.col("value")))


@register("feature_store", f"""WITH {S.COMMENTS_CTE}
SELECT comment_id, """ + ", ".join(f"round(CAST({FEATURE_SQL[_SET_SQL[n]]} AS DOUBLE), 6) AS f_{n}" for n in _SET)
          + " FROM comments")
def q_feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table after a round trip through the store."""
    from glosa.plans.pipeline import RunConfig, feature_table
    cfg = RunConfig(name="feature-store", features=_SET, num_trials=1)
    feats, layout = feature_table(spark, _comments(spark, sf_dir), cfg, reg.FeatureAssets(), cache_tag="query")
    return feats.select(COMMENT_ID, *[r6(F.col(c)).alias(c) for c in layout.numerical])


_ASM = ["NumWords", "NumCharacters", "DocumentEmbeddingsBERT"]


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = lt.doc_vectors_from_embeddings(load_table(spark, sf_dir, "embeddings"))
    assets = reg.FeatureAssets(doc_vectors={"DocumentEmbeddingsBERT": (vecs, 64)})
    feats, layout = reg.build_features(_comments(spark, sf_dir), _ASM, assets)
    a = reg.assemble(feats, layout)
    return VectorAssembler(inputCols=["num", "emb"], outputCol="features").transform(a)


_ASM_SQL = f"""WITH {S.COMMENTS_CTE},
nums AS (
  SELECT comment_id, {FEATURE_SQL['f_num_words']} AS a, {FEATURE_SQL['f_num_characters']} AS b FROM comments
),
has AS (SELECT n.*, e.vec_id IS NOT NULL AS held FROM nums n LEFT JOIN embeddings e ON e.vec_id = n.comment_id),
e AS (
  SELECT comment_id, i, coalesce(CAST(embedding[i + 1] AS DOUBLE), 0.0) AS v
  FROM has LEFT JOIN embeddings ON vec_id = comment_id CROSS JOIN (SELECT unnest(range(0, 64)) AS i)
)"""


@register("feature_assemble", f"""{_ASM_SQL}
SELECT comment_id, 0 AS idx, round(a, 6) AS value FROM has
UNION ALL
SELECT comment_id, 1, round(b, 6) FROM has
UNION ALL
SELECT comment_id, 2, CASE WHEN held THEN 1.0 ELSE 0.0 END FROM has
UNION ALL
SELECT comment_id, CAST(i + 3 AS INT), round(v, 6) FROM e""")
def q_feature_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: two numbers, whether it has a vector, and the vector or zeros."""
    a = _assembled(spark, sf_dir)
    return a.select(COMMENT_ID, F.posexplode(vector_to_array("features")).alias("idx", "value")).withColumn(
        "value", r6(F.col("value")))


@register("feature_block_select", f"""{_ASM_SQL}
SELECT comment_id, CAST(i AS INT) AS idx, round(v, 6) AS value FROM e""")
def q_feature_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assembled(spark, sf_dir)
    emb = VectorSlicer(inputCol="features", outputCol="block", indices=list(range(3, 3 + 64))).transform(a)
    return emb.select(COMMENT_ID, F.posexplode(vector_to_array("block")).alias("idx", "value")).withColumn(
        "value", r6(F.col("value")))


# ---------------------------------------------------------------------------
# G3(b), G4: batch scoring hook and the sentiment model's input
# ---------------------------------------------------------------------------
from glosa.operators import scoring as sc  # noqa: E402
from glosa.operators import style as st  # noqa: E402

SCORE_DIM = 4


SCORE_SEED, SCORE_IN = 7, 64


def _score_weights_sql() -> str:
    """The stand-in model's weights as a VALUES table (same seeded draw)."""
    import numpy as np
    w = np.random.default_rng(SCORE_SEED).standard_normal((SCORE_IN, SCORE_DIM))
    return ", ".join(f"({i}, {j}, {float(w[i, j])!r})" for i in range(SCORE_IN) for j in range(SCORE_DIM))


@register("score_batch", f"""WITH w(i, j, wv) AS (VALUES {_score_weights_sql()}),
e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT e.vec_id, CAST(w.j AS INT) AS output, round(sum(e.x * w.wv), 6) AS value
FROM e JOIN w ON w.i = e.i GROUP BY e.vec_id, w.j""")
def q_score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user model through Arrow batches (here a seeded linear map), one row per (vector, output)."""
    e = load_table(spark, sf_dir, "embeddings")
    score = sc.batch_scorer(sc.seeded_projection(SCORE_IN, SCORE_DIM, SCORE_SEED), SCORE_DIM, batch_size=128,
                            input_shape=[SCORE_IN])
    out = e.select("vec_id", score(F.col("embedding").cast("array<double>")).alias("scores"))
    return out.select("vec_id", F.posexplode("scores").alias("output", "value")).withColumn(
        "value", r6(F.col("value")))


ENSEMBLE_FOLDS, ENSEMBLE_SEED = 7, 11


def _ensemble_weights():
    """Seeded weights and intercepts of fold × task models on the embeddings."""
    import numpy as np
    rng = np.random.default_rng(ENSEMBLE_SEED)
    n = ENSEMBLE_FOLDS * len(LABELS)
    return rng.standard_normal((n, SCORE_IN)).round(6), rng.standard_normal(n).round(6)


def _ensemble_sql() -> tuple[str, str]:
    w, b = _ensemble_weights()
    rows = ", ".join(f"({m}, {i}, {float(w[m, i])!r})" for m in range(len(w)) for i in range(SCORE_IN))
    return rows, ", ".join(f"({m}, {float(b[m])!r})" for m in range(len(b)))


_ENS_W, _ENS_B = _ensemble_sql()


@register("ensemble_score", f"""WITH w(m, i, wv) AS (VALUES {_ENS_W}),
b(m, bv) AS (VALUES {_ENS_B}),
e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
s AS (SELECT vec_id, w.m, sum(x * wv) AS dot FROM e JOIN w USING (i) GROUP BY vec_id, w.m),
v AS (SELECT vec_id, m % {len(LABELS)} AS task, sum(CASE WHEN dot + bv > 0 THEN 1 ELSE 0 END) AS yes, count(*) AS n
      FROM s JOIN b USING (m) GROUP BY vec_id, m % {len(LABELS)})
SELECT vec_id, CAST(task AS INT) AS task, CAST(yes AS INT) AS yes, CASE WHEN 2 * yes >= n THEN 1 ELSE 0 END AS vote FROM v""")
def q_ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold × task models as one matrix over the raw vector, then the vote."""
    from glosa.operators.model import positive_margins
    w, b = _ensemble_weights()
    e = load_table(spark, sf_dir, "embeddings").select(
        "vec_id", positive_margins(w, b)(F.col("embedding").cast("array<double>")).alias("p"))
    per_task = [[F.col("p")[k * len(LABELS) + t] for k in range(ENSEMBLE_FOLDS)] for t in range(len(LABELS))]
    items = [F.struct(F.lit(t).alias("task"), sum(ps[1:], ps[0]).cast("int").alias("yes"), ens.vote(ps).alias("vote"))
             for t, ps in enumerate(per_task)]
    return e.select("vec_id", F.explode(F.array(*items)).alias("r")).select("vec_id", "r.*")


@register("importance_topk", """WITH x AS (
  SELECT label AS fold, unnest(range(0, len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings
),
c AS (SELECT fold, idx, round(abs(avg(v)), 6) AS importance FROM x GROUP BY fold, idx),
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, idx) AS rank FROM c)
SELECT CAST(fold AS INT) AS fold, CAST(idx AS INT) AS idx, importance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def q_importance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 on a coefficient table from the vectors: mean of each dimension by label."""
    from glosa.operators.model import top_k_importance
    e = load_table(spark, sf_dir, "embeddings")
    x = e.select(F.col("label").cast("int").alias("fold"), F.posexplode(F.col("embedding").cast("array<double>")).alias("idx", "v"))
    c = x.groupBy("fold", "idx").agg(r6(F.abs(F.avg("v"))).alias("importance")).withColumn("task", F.lit("Toxic"))
    return top_k_importance(c, 10).select("fold", "idx", "importance", "rank")


@register("score_input_chunks", f"""WITH {S.COMMENTS_CTE},
c AS (SELECT comment_id, list_filter(string_split({_CLEAN_SQL}, ' '), lambda x: x <> '') AS tk FROM comments),
k AS (SELECT comment_id, tk, unnest(range(0, greatest(len(tk), 1), {sc.MODEL_INPUT_TOKENS})) AS first FROM c)
SELECT comment_id, CAST(first // {sc.MODEL_INPUT_TOKENS} AS INT) AS chunk, CAST(len(tk) AS INT) AS n_words,
       array_to_string(tk[first + 1:first + {sc.MODEL_INPUT_TOKENS}], ' ') AS model_input FROM k""")
def q_score_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentiment model's inputs: all of the cleaned text, in chunks of its input size."""
    c = _comments(spark, sf_dir).select(COMMENT_ID, tx.clean_text(F.col(TEXT)).alias("cleaned"))
    toks = F.filter(F.split("cleaned", " "), lambda x: x != F.lit(""))
    c = c.select(COMMENT_ID, F.size(toks).cast("int").alias("n_words"), sc.model_input_chunks(F.col("cleaned")).alias("chunks"))
    return c.select(COMMENT_ID, "n_words", F.posexplode("chunks").alias("chunk", "model_input"))


def _weight_rows(w) -> str:
    return ", ".join(f"({i}, {j}, {float(w[i, j])!r})" for i in range(w.shape[0]) for j in range(w.shape[1]))


@register("sentiment_scores", f"""WITH {S.COMMENTS_CTE},
c AS (SELECT comment_id, list_filter(string_split({_CLEAN_SQL}, ' '), lambda x: x <> '') AS tk FROM comments),
k AS (
  SELECT comment_id, tk[first + 1:first + {sc.MODEL_INPUT_TOKENS}] AS part
  FROM (SELECT comment_id, tk, unnest(range(0, greatest(len(tk), 1), {sc.MODEL_INPUT_TOKENS})) AS first FROM c)
),
t AS (SELECT comment_id, greatest(len(part), 1) AS n, array_to_string(part, ' ') AS t FROM k),
x AS (
  SELECT comment_id, n, unnest([length(t), length(t) - length(replace(t, ' ', '')), length(t) - length(replace(t, 'e', '')),
                                length(t) - length(replace(t, 'n', ''))]) / 100.0 AS v, unnest([0, 1, 2, 3]) AS i FROM t
),
w(i, j, wv) AS (VALUES {_weight_rows(sc.class_weights())})
SELECT comment_id, CAST(j AS INT) AS class, round(sum(v * wv * n) / (sum(n) / 4), 6) AS score FROM x JOIN w USING (i) GROUP BY comment_id, j""")
def q_sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 through the registry: a stand-in classifier over all chunks of every text, averaged by their tokens."""
    scorer = sc.batch_scorer(sc.seeded_text_classifier(3), 3)
    feats, layout = reg.build_features(_comments(spark, sf_dir), ["SentimentBERT"], reg.FeatureAssets(scorers={"SentimentBERT": (scorer, 3)}))
    scores = F.array(*[F.col(c) for c in layout.numerical])
    return feats.select(COMMENT_ID, F.posexplode(scores).alias("class", "score")).withColumn("score", r6(F.col("score")))


STYLE_DIM = 100


@register("writing_style", f"""WITH {_WIN_TOK_CTE},
freq AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOK_LOWER}) AS token FROM comments) GROUP BY token),
vocab AS (SELECT token, CAST(rn + 1 AS INT) AS id FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rn FROM freq)),
x AS (
  SELECT comment_id, window_idx, sum(coalesce(v.id, 1)) / 10000.0 AS a,
         sum(list_sum(list_transform(regexp_extract_all(t.token, '(?s).'), lambda ch: CASE WHEN ch >= 'a' AND ch <= 'z' THEN ascii(ch) - 95 ELSE 1 END)))
           / 10000.0 AS b, sum(length(t.token)) / 10000.0 AS c, count(*) / 10000.0 AS d
  FROM wtok t LEFT JOIN vocab v ON v.token = t.token GROUP BY ALL
),
wts(i, j, wv) AS (VALUES {_weight_rows(st.style_weights(STYLE_DIM))}),
p AS (SELECT j, max(wv) FILTER (i = 0) AS wa, max(wv) FILTER (i = 1) AS wb, max(wv) FILTER (i = 2) AS wc, max(wv) FILTER (i = 3) AS wd FROM wts GROUP BY j),
s AS (SELECT x.*, a * wa + b * wb + c * wc + d * wd AS s FROM x JOIN p ON j = 0),
m AS (SELECT comment_id, max(s) AS mx FROM s GROUP BY comment_id),
z AS (
  SELECT comment_id, sum(exp(s - mx)) AS z, sum(exp(s - mx) * a) AS a, sum(exp(s - mx) * b) AS b, sum(exp(s - mx) * c) AS c, sum(exp(s - mx) * d) AS d
  FROM s JOIN m USING (comment_id) GROUP BY comment_id
),
q AS (SELECT comment_id, j - 1 AS dim, (a * wa + b * wb + c * wc + d * wd) / z AS value FROM z JOIN p ON j > 0)
SELECT comments.comment_id, CAST(k.dim AS INT) AS dim, round(coalesce(q.value, 0), 6) AS value
FROM comments CROSS JOIN (SELECT unnest(range(0, {STYLE_DIM})) AS dim) k
LEFT JOIN q ON q.comment_id = comments.comment_id AND q.dim = k.dim""")
def q_writing_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 → G3: every window through padded tensors and a stand-in model, pooled by its attention scores."""
    c = _comments(spark, sf_dir)
    assets = reg.FeatureAssets(style=fl.stand_in_style(spark, c, STYLE_DIM))
    feats, layout = reg.build_features(c, ["WritingStyleEmbeddings"], assets)
    return feats.select(COMMENT_ID, F.posexplode(layout.embeddings[0][0]).alias("dim", "value")).withColumn("value", r6(F.col("value")))


# ---------------------------------------------------------------------------
# M3–M11, A1/A2 on real fits: the cross-validated run (rows-only checks)
# ---------------------------------------------------------------------------
from glosa.plans import flagship as fl  # noqa: E402


@register("fit_predict_tasks")
def q_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fixed model (k = 8, C = 1) on every labelled row; predictions."""
    from glosa.operators.model import FoldModel, fit_shared, fit_task, trial_features
    from glosa.session import cut_lineage
    train, _, assets = fl.flagship_inputs(spark, sf_dir)
    feats, layout = reg.build_features(cut_lineage(train), fl.FLAGSHIP_FEATURES, assets)
    data = reg.assemble(cut_lineage(feats), layout)  # the fits read the features again and again
    shared = fit_shared(data, layout, 8)
    x = trial_features(shared, 8).transform(shared.model.transform(data))
    n = x.count()
    regs = [fit_task(x, "m_xk", lab, 1.0, n, "m_", t) for t, lab in enumerate(LABELS)]
    model = FoldModel(shared, 8, 1.0, regs, [f"pred_{t}" for t in range(3)])
    return model.predict(data.select(COMMENT_ID, *LABELS, "num", "emb")).select(
        COMMENT_ID, *LABELS, "pred_0", "pred_1", "pred_2")


@register("tune")
def q_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flagship_run(spark, sf_dir).cv.trials


@register("oof_predictions")
def q_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flagship_run(spark, sf_dir).cv.oof


@register("cv_task_metrics")
def q_cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flagship_run(spark, sf_dir).cv.metrics


@register("cv_metrics_summary")
def q_cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flagship_run(spark, sf_dir).cv.summary


@register("feature_importance_topk")
def q_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flagship_run(spark, sf_dir).cv.importance


_SUBMISSION_SQL = """SELECT CAST(doc_id AS VARCHAR) AS comment_id, 3 AS n_labels, true AS binary
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""


def _submission_rows(spark: SparkSession, sf_dir: str, predictions: DataFrame) -> DataFrame:
    """The submission written from a run's predictions, read back: a row for each unlabelled comment, 0/1 labels."""
    from glosa.session import shared_dir
    from glosa.sources import sinks
    import uuid
    test = _comments(spark, sf_dir).join(load_table(spark, sf_dir, "labels").select(F.col("doc_id").alias(COMMENT_ID)),
                                         COMMENT_ID, "left_anti")
    out = f"{shared_dir(spark)}/submission-{uuid.uuid4().hex}"
    sinks.write_submission(sinks.attach_predictions(test, predictions), out)
    rows = spark.read.csv(f"{out}/submission", header=True)
    given = [F.col(c).isin("0", "1") for c in LABELS]
    return rows.select(COMMENT_ID, sum((g.cast("int") for g in given[1:]), given[0].cast("int")).alias("n_labels"),
                       (given[0] & given[1] & given[2]).alias("binary"))


@register("submission_rows", _SUBMISSION_SQL)
def q_submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _submission_rows(spark, sf_dir, fl.flagship_run(spark, sf_dir).predictions)


@register("submission_baseline_bert", _SUBMISSION_SQL)
def q_submission_bert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document-vector baseline at its configured folds and trials."""
    return _submission_rows(spark, sf_dir, fl.config_run(spark, sf_dir, "baseline-bert").predictions)


@register("submission_baseline_fasttext", _SUBMISSION_SQL)
def q_submission_fasttext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled-vector baseline at its configured folds, trials and width."""
    return _submission_rows(spark, sf_dir, fl.config_run(spark, sf_dir, "baseline-fasttext").predictions)


@register("test_predictions")
def q_test_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flagship_run(spark, sf_dir).predictions
