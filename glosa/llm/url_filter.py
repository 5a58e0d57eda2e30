"""Operator 11: verdicts on urls by host and path rules and a list of canonical urls.

A rule (host, path) fits urls on its host and all subdomains whose path starts with
the rule's; the longest that fits decides. Where none fits, the list does: a url
whose canonical form is listed is blocked, any other allowed.

The list may be of any length, so pages are not shuffled to meet it:

1. The distinct listed forms set bits in a blocked Bloom filter. One hash of a form
   picks a block of 512 bits, another one bit in each of the block's eight words.
   The words of a block are or-ed where the list is read. There are 16 bits to a
   form, ``max_blocks`` blocks at most (at the default 64 MB, 33 million forms);
   a longer list passes more false positives and loses nothing.
2. The filter, bounded by ``max_blocks``, is broadcast. A page whose bits are not
   all set is not listed, and is done.
3. Possible hits go to a hash join with the list on the canonical form itself, which
   removes false positives. The list is distinct and stored, so a form that very
   many pages share is split by the skew join.

Canonical form: A-Z of scheme and host in lower case, no user, no ``www.``, no dot at
the host's end, no port 80 or 443, no fragment, no slash at the path's end, no
tracking parameters, the others in order; http and https are one, other schemes
stay in front. A null url, or one without ``://``, has an empty host and path and no
canonical form: no rule fits, it is never listed and allowed. Null rows of the list
are ignored, repeated ones count once; an empty list allows all that no rule blocks.
Repeated rows of pages are judged one by one. An empty table gives no rows.

Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import stored

WORDS = 8  # of 64 bits in a block
BITS_A_KEY = 16
MAX_BLOCKS = 1 << 20
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|\z)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return lower_ascii(host), path


def canonical_url(url: Column) -> Column:
    """Canonical form as of the module's docstring; null without ``://``."""
    host, path = host_and_path(url)
    scheme = lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    scheme = F.when(scheme.isin("http", "https"), F.lit("")).otherwise(F.concat(scheme, F.lit("://")))
    host = F.regexp_replace(host, r"(?s)^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?\z", ""), r"\.+\z", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(path, r"/+\z", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    params = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(params), "&"))).otherwise(F.lit(""))
    return F.when(F.locate("://", url) > 0, F.concat(scheme, host, path, query))


def fitting_rule(rules: Sequence[UrlRule], host: Column, path: Column) -> Column:
    """The longest rule that fits as a struct (name, verdict), else null. Of equally long ones, the first by name."""
    out = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        on = (host == rule.host) | host.endswith("." + rule.host)
        out = F.when(on & path.startswith(rule.path), F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
                     ).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1))


def _masks(key: Column) -> list[Column]:
    """The bit of each word that a key sets: six bits of its second hash for each."""
    drawn = F.xxhash64(key, F.lit(1))
    at = [F.shiftrightunsigned(drawn, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), a) for a in at]


def bloom_filter(keys: DataFrame, n_keys: int, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """(rows of block and its words w0..w7, number of blocks) over the column ``key``; blocks without a key have no row."""
    blocks = 1
    while blocks < max_blocks and blocks * WORDS * 64 < n_keys * BITS_A_KEY:
        blocks *= 2
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{k}") for k, m in enumerate(_masks(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]), blocks


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: Sequence[UrlRule], *, url_col: str = "url",
                 listed_col: str = "url", carry: list[str] | None = None, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per page: ``row`` (a struct of its columns, or of those in ``carry``), ``host``, ``path``, ``rule``
    (host and path of the rule that decided, else null), ``canonical``, ``possible`` (the filter was asked and
    passed the page on) and ``verdict`` (allow or block).

    ``listed`` has urls to block in any form; they are made canonical here.
    """
    if max_blocks < 1 or max_blocks & (max_blocks - 1):
        raise ValueError("max_blocks must be a power of two")
    keys = stored(listed.select(canonical_url(F.col(listed_col)).alias("key")).where("key is not null").distinct(), "listed")
    bits, blocks = bloom_filter(keys, keys.count(), max_blocks)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.struct(*(carry if carry is not None else pages.columns)).alias("row"), host.alias("host"),
                        path.alias("path"), canonical_url(F.col(url_col)).alias("canonical"))
    rows = rows.withColumn("fits", fitting_rule(rules, F.col("host"), F.col("path")))
    # A row for a block at most: bounded by max_blocks.
    asked = rows.withColumn("block", F.when(F.col("fits").isNull(), _block(F.col("canonical"), blocks)))
    asked = asked.join(F.broadcast(bits), "block", "left")
    hit = F.lit(True)
    for k, mask in enumerate(_masks(F.col("canonical"))):
        hit = hit & (F.col(f"w{k}").bitwiseAND(mask) != 0)
    asked = asked.select("row", "host", "path", "canonical", "fits",
                         F.coalesce(hit & F.col("canonical").isNotNull(), F.lit(False)).alias("possible"))
    done = asked.where("not possible").withColumn("key", F.lit(None).cast("string"))
    checked = asked.where("possible").join(keys, F.col("canonical") == F.col("key"), "left")
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("key").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return done.unionByName(checked).select("row", "host", "path", F.col("fits.name").alias("rule"), "canonical", "possible",
                                            verdict.alias("verdict"))
