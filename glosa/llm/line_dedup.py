"""Operator 2: boilerplate lines by their frequency within a site.

A page's markup becomes lines at block-level tags; scripts, styles and comments
go, other tags vanish and white space collapses; a comment, script or style that is
not closed goes to the end of the page. Within each host, a line's frequency is the
number of the host's pages that have it divided by the host's pages. A line is dropped
where it is above ``max_ratio`` and on at least ``least_pages`` pages of the host: on
fewer, a repetition says nothing, however small the host.

Page counts are sums of distinct (page, line) rows: those are made distinct
within the task that reads the page, so a host with a third of all pages and a
line on all its pages are pre-aggregated where they are read. Lines travel as
128-bit hashes. Only the frequent lines come back to the pages, as one list per
host; a list has at most lines-per-page / max_ratio entries, as the shares of a
page's lines add up. No pattern reads a part of a page more than a few times, so
unclosed marks in long pages cost no more than others.

Built-in functions only. A null html has no lines, a url without a host (or
null) is the host "". Repeated rows of a page count as pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import stored

# White space as of the contracts' words.
SPACE = r"[\x20\x09-\x0D]+"
BLOCK = (r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|nav|article|section|header|footer|main|aside|title|body|head|html"
         r"|blockquote|pre|form|option|dt|dd|td|th)\b[^<>]*+>")
# A bare "<" is text: a tag begins with a letter, "!" or "?" and has another "<" within quotes only.
TAG = r"""<(?:/\s*)?[A-Za-z!?](?:(?:[^<>"']++|"[^">]*+"|'[^'>]*+')*+>|[^<>]*+>)"""
# What is not closed runs to the end, so that no opening mark is tried twice.
HIDDEN = (r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*+(?:>.*?(?:</script\s*+>|\z)|\z)|<style\b[^>]*+(?:>.*?(?:</style\s*+>|\z)|\z)")


def lines_of(html: Column) -> Column:
    """Text lines of a page, in order, without empty ones."""
    text = F.regexp_replace(html, HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    return F.filter(lines, lambda x: x != "")


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def site_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *,
               max_ratio: float = 0.2, least_pages: int = 3) -> DataFrame:
    """One row per page: id, host, n_lines, n_dropped and ``text``, the lines that stay.

    An empty table gives no rows.
    """
    lines = F.coalesce(lines_of(F.col(html_col)), F.array().cast("array<string>"))
    rows = stored(pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), lines.alias("lines")),
                  "lines")
    keys = F.array_distinct(F.transform("lines", _key))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    with_line = (rows.select("host", F.explode(keys).alias("key")).groupBy("host", "key")
                 .agg(F.count(F.lit(1)).alias("with_line")).where(F.col("with_line") >= least_pages))
    frequent = (with_line.join(totals, "host").where(F.col("with_line") > max_ratio * F.col("pages"))
                .groupBy("host").agg(F.collect_list("key").alias("frequent")))
    # Stored, so that the join reads two plain exchanges and can split a hot host.
    frequent = stored(frequent, "frequent")
    out = rows.join(frequent, "host", "left")
    left = F.when(F.col("frequent").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("frequent"), _key(x))))
    out = out.select("id", "host", F.size("lines").cast("long").alias("n_lines"), left.alias("left"))
    return out.select(F.col("id").alias(id_col), "host", "n_lines",
                      (F.col("n_lines") - F.size("left")).cast("long").alias("n_dropped"),
                      F.array_join("left", "\n").alias("text"))
