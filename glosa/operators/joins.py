"""Lookup joins of exploded facts (tokens, windows, groups) to keyed tables.

Token streams are the skew case: a handful of function words can make up a
large share of all token rows. Three plans, picked by measured sizes:

* the lookup table is broadcast when its measured size is under a cap
  (no shuffle of the token rows at all);
* otherwise the join is a shuffle join whose hot keys are salted. Hot keys
  are found with a grouped count (partial aggregation collapses them
  map-side); a key is hot when it holds more rows than an average shuffle
  partition, so there are fewer hot keys than partitions — a proven bound for
  the broadcast of the hot-key list. Fact rows of a hot key spread over as
  many salts as its count asks for, taken from a hash of their own columns
  (stable under task retries); only the hot lookup rows are replicated, once
  per salt. Rows without a key bypass the join;
* where table rows are wide (word vectors), ``layered``: the table's rows of the
  most frequent keys, as many as the cap holds, are broadcast, and only the facts of
  rarer keys meet the table in a shuffle. Of n occurrences a rarer key has about
  n / (keys broadcast) at most, so the shuffle has no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosa.session import cut_lineage

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def _value_bytes(t: T.DataType, c: Column) -> Column:
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 8
    if isinstance(t, T.ArrayType):
        if not isinstance(t.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
            return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 16
        total = F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _value_bytes(t.elementType, x))
        return F.coalesce(total, F.lit(0).cast("long")) + 16
    return F.lit(8).cast("long")


def _row_bytes(df: DataFrame) -> Column:
    width = None
    for f in df.schema.fields:
        b = _value_bytes(f.dataType, F.col(f"`{f.name}`"))
        width = b if width is None else width + b
    return width


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes) of a lookup table in one aggregate pass."""
    width = _row_bytes(df)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return int(r["n"] or 0), int(r["b"] or 0)


def fits_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    return measured_size(df)[1] <= max_bytes


def lookup_join(facts: DataFrame, table: DataFrame, key: str, how: str = "inner", *,
                strategy: str = "auto", max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                salt_buckets: int | None = None, salt_cols: Sequence[str] | None = None) -> DataFrame:
    """Join ``facts`` (many rows per key) to ``table`` (one row per key).

    ``strategy``: ``auto`` (size check), ``broadcast`` or ``salted``.
    ``how``: ``inner`` or ``left`` (facts kept).
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if strategy == "auto":
        strategy = "broadcast" if fits_broadcast(table, max_broadcast_bytes) else "salted"
    if strategy == "broadcast":
        return facts.join(F.broadcast(table), key, how)
    if strategy != "salted":
        raise ValueError(f"unknown strategy {strategy!r}")
    return salted_join(facts, table, key, how, salt_buckets=salt_buckets, salt_cols=salt_cols)


def frequent_keys(keys: DataFrame, key: str, most: int) -> DataFrame:
    """The most frequent values of ``keys``, ``most`` at most, stored. ``keys`` has a row for
    each occurrence, or one for each value and their number as ``_n``.

    Found without a sort: keys are counted by level, a level being a quarter of a
    power of two, and all levels taken from the top on that fit together."""
    freq = keys.where(F.col(key).isNotNull())
    if "_n" not in keys.columns:
        freq = freq.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    freq = cut_lineage(freq.select(key, F.floor(4 * F.log2("_n")).cast("int").alias("_level")))
    taken, least = 0, 4 * 64
    for level, n in sorted(freq.groupBy("_level").agg(F.count(F.lit(1))).collect(), reverse=True):  # 256 levels at most
        if taken + n > most:
            break
        taken, least = taken + n, level
    return freq.where(F.col("_level") >= least).select(key)


def layered_join(facts: DataFrame, table: DataFrame, key: str, keys: DataFrame, *,
                 max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Left join: rows of frequent keys meet a broadcast part of the table, the others the table.

    ``keys`` has the key of each occurrence (at least one for each row of ``facts``), or the counted keys (``frequent_keys``)."""
    widest = table.agg(F.max(_row_bytes(table))).first()[0] or 1
    hot = frequent_keys(keys, key, max_broadcast_bytes // int(widest))
    part = hot.join(table.join(F.broadcast(hot), key), key, "left").withColumn("_hot", F.lit(True))
    near = facts.join(F.broadcast(part), key, "left").where(F.col("_hot") | F.col(key).isNull()).drop("_hot")
    far = facts.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(table, key, "left")
    return near.unionByName(far)


def hot_keys(facts: DataFrame, key: str) -> DataFrame:
    """Keys holding more rows than an average shuffle partition (fewer keys than
    partitions, hence safe to broadcast), with the number of salts that cuts each
    into parts of about that size."""
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    freq = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = freq.agg(F.sum("_n")).first()[0] or 0
    share = max(total // max(parts, 1), 1)
    return freq.where(F.col("_n") > F.lit(share)).select(
        key, F.ceil(F.col("_n") / F.lit(float(share))).cast("int").alias("_salts"))


def salted_join(facts: DataFrame, table: DataFrame, key: str, how: str = "inner", *,
                salt_buckets: int | None = None, salt_cols: Sequence[str] | None = None,
                hot: DataFrame | None = None) -> DataFrame:
    """Shuffle join with hot keys cut into salts: by their counts, or ``salt_buckets``
    for each. Rows without a key match nothing and stay out of the join."""
    hot = hot if hot is not None else hot_keys(facts, key)
    if salt_buckets is not None or "_salts" not in hot.columns:
        hot = hot.select(key, F.lit(salt_buckets or 32).alias("_salts"))
    cols = list(salt_cols or [c for c in facts.columns if c != key])
    salt_src = F.xxhash64(*[F.col(c) for c in cols]) if cols else F.lit(0)
    f2 = (facts.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left")
          .withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(salt_src, F.col("_salts"))).otherwise(F.lit(0)))
          .drop("_salts"))
    t2 = (table.join(F.broadcast(hot), key, "left")
          .withColumn("_salt", F.explode(F.when(F.col("_salts").isNotNull(),
                                                F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))))
          .drop("_salts"))
    joined = f2.join(t2, [key, "_salt"], how).drop("_salt")
    if how == "inner":
        return joined
    return joined.unionByName(facts.where(F.col(key).isNull()), allowMissingColumns=True)
