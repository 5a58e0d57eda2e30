"""Shared SQL fragments for the DuckDB oracles (written from the formulas)."""

from glosa.functions.text import PY_WHITESPACE

WS_RUN = f"[{PY_WHITESPACE}]+"
NON_WS = f"[^{PY_WHITESPACE}]"

COMMENTS_CTE = """comments AS (
  SELECT doc_id AS comment_id,
         text
         || repeat(' @USER',            CAST(doc_id % 3 AS INT))
         || repeat(' @medium',          CAST(doc_id % 4 AS INT))
         || repeat(' https://ex.org/a', CAST(doc_id % 5 AS INT))
         || repeat(' \U0001F600',               CAST(doc_id % 7 AS INT))
         || repeat(' \U0001F389',               CAST(doc_id % 2 AS INT)) AS c_text
  FROM documents
)"""

LABELLED_CTE = COMMENTS_CTE + """,
labelled AS (
  SELECT c.comment_id, c.c_text,
         CAST(l.toxic AS INT)   AS Sub1_Toxic,
         CAST(l.quality AS INT) AS Sub2_Engaging,
         CAST(regexp_matches(d.text, '[0-9]') AS INT) AS Sub3_FactClaiming
  FROM comments c JOIN labels l ON l.doc_id = c.comment_id
  JOIN documents d ON d.doc_id = c.comment_id
)"""


def tokens_sql(expr: str) -> str:
    """Python str.split() in DuckDB."""
    return f"list_filter(regexp_split_to_array({expr}, '{WS_RUN}'), lambda x: x <> '')"


def log_sql(expr: str) -> str:
    return f"ln(CAST({expr} AS DOUBLE) + 1e-9)"
