"""Token windows (G6) and the token re-join of pre-tokenised text.

Windows start at token 0, hop, 2·hop, … while a token remains, hold at most
``window`` tokens (tail windows are shorter), and an optional ``max_windows``
keeps the first ones, as the style model's input tensor does. Everything is
array arithmetic inside the row; ``posexplode`` turns windows into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, TEXT
from glosa.functions.text import tokens


def check_window(window: int, hop: int) -> None:
    if hop < 1:
        raise ValueError("hop must be at least 1")  # 0 would never end, < 0 is meaningless
    if window < 1:
        raise ValueError("window must be at least 1")


def window_starts(toks: Column, hop: int, max_windows: int | None = None) -> Column:
    n = F.size(toks)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    if max_windows is not None:
        starts = F.slice(starts, 1, max_windows)
    return starts


def window_tokens(toks: Column, window: int, hop: int, max_windows: int | None = None) -> Column:
    """``array<array<string>>`` of windows."""
    check_window(window, hop)
    last = F.size(toks) - 1
    # Tokens are taken one by one: ``slice`` reads the whole array for each window.
    return F.transform(window_starts(toks, hop, max_windows),
                       lambda i: F.transform(F.sequence(i, F.least(i + (window - 1), last)), lambda j: F.get(toks, j)))


def token_windows(df: DataFrame, window: int, hop: int, max_windows: int | None = None,
                  text_col: str = TEXT, id_col: str = COMMENT_ID) -> DataFrame:
    """One row per window: ``(id, window_idx, window_tokens array, window string)``.

    Tokens are projected first and the windows slice that column: a token
    expression inside the window lambda would re-split the whole text once per
    window (quadratic in the document length)."""
    toks = df.select(id_col, tokens(F.col(text_col)).alias("_tok"))
    w = window_tokens(F.col("_tok"), window, hop, max_windows)
    return (toks.select(id_col, F.posexplode(w).alias("window_idx", "window_tokens"))
            .withColumn("window", F.array_join("window_tokens", " ")))


def join_tokens(sentences: Column) -> Column:
    """Pre-tokenised sentences ``array<array<string>>`` → one space-separated string."""
    return F.trim(F.array_join(F.flatten(sentences), " "))


def sentences_by_line(text: Column) -> Column:
    """Lines as sentences, whitespace tokens per line (stand-in tokeniser input)."""
    return F.transform(F.split(text, "\n"), lambda s: tokens(s))
