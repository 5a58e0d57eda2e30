"""Label codes, stratified k-fold assignment and fold splits.

The fold rule keeps the balance guarantees of a stratified k-fold split —
inside every class the fold sizes differ by at most one, and so do the fold
totals — without ever ranking a whole class in one task:

* each row gets a seeded order key ``h = md5(seed:id)``;
* the first ``bucket_digits`` hex digits of ``h`` cut every class into
  ``16**bucket_digits`` ranges of that order (chosen from the largest class
  so that no range holds more than about a million rows);
* per-(class, range) counts form a table bounded by classes × ranges, whose
  prefix sums give each range its start position (broadcast, size proven);
* ``row_number`` runs inside a (class, range) group only.

The resulting global position inside a class equals a plain ``ORDER BY h, id``
rank, so a single-window SQL query reproduces it exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, FOLD, LABELS

CODE = "label_code"
CLASS_ID = "class_id"


def label_code(labels: Sequence[str] = LABELS) -> Column:
    """Row of 0/1 labels rendered like a NumPy row: ``[a b c]``."""
    parts: list[Column] = []
    for i, c in enumerate(labels):
        if i:
            parts.append(F.lit(" "))
        parts.append(F.col(c).cast("string"))
    return F.concat(F.lit("["), *parts, F.lit("]"))


def _bounded_codes(df: DataFrame, code_col: str, bound: int) -> list[str]:
    """Distinct codes, collected only because their number is bounded."""
    rows = df.where(F.col(code_col).isNotNull()).select(code_col).distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} distinct label codes; labels must be 0/1")
    return sorted(r[0] for r in rows)


def multilabel_to_multiclass(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Add ``label_code`` and ``class_id`` = rank of the code among the sorted
    distinct codes (at most 2**len(labels) of them); null where a label is null."""
    coded = df.withColumn(CODE, label_code(labels))
    codes = _bounded_codes(coded, CODE, 2 ** len(labels))
    mapping = F.create_map(*[x for i, c in enumerate(codes) for x in (F.lit(c), F.lit(i))])
    return coded.withColumn(CLASS_ID, F.element_at(mapping, F.col(CODE)).cast("int"))


# Largest number of rows one (class, range) group should rank in one task,
# and the caps that keep the broadcast start table (classes × 16**digits rows)
# small.
TARGET_GROUP_ROWS = 1_000_000
MAX_BUCKET_DIGITS = 4
MAX_START_ROWS = 1 << 20


def auto_bucket_digits(largest_class: int, n_classes: int = 8, target: int = TARGET_GROUP_ROWS) -> int:
    """Fewest hex digits that cut the largest class into groups of ≤ ``target``
    rows, within the cap on the start table (``n_classes × 16**digits`` rows)."""
    d = 1
    while (d < MAX_BUCKET_DIGITS and largest_class > target * 16 ** d
           and max(n_classes, 1) * 16 ** (d + 1) <= MAX_START_ROWS):
        d += 1
    return d


def stratified_folds(df: DataFrame, k: int = 7, seed: int = 42, class_col: str = CODE,
                     id_col: str = COMMENT_ID, bucket_digits: int | None = None,
                     max_classes: int = 256) -> DataFrame:
    """Add ``fold`` in ``[0, k)`` balanced per class and overall. A row without
    a class stays, with a null fold.

    ``bucket_digits=None`` sizes the hash ranges from the largest class; the
    folds do not depend on it."""
    if k < 2:
        raise ValueError("k must be at least 2")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    unlabelled = df.where(F.col(class_col).isNull()).withColumn(FOLD, F.lit(None).cast("int"))
    df = df.where(F.col(class_col).isNotNull())
    # Class totals: classes are few (bounded), so this is a tiny collect.
    totals = (df.groupBy(class_col).agg(F.count(F.lit(1)).alias("_t"))
              .limit(max_classes + 1).collect())
    if len(totals) > max_classes:
        raise ValueError(f"more than {max_classes} classes to stratify")
    if bucket_digits is None:
        bucket_digits = auto_bucket_digits(max((r[1] for r in totals), default=0), len(totals))
    if len(totals) * 16 ** bucket_digits > MAX_START_ROWS:
        raise ValueError("start table too large to broadcast; use fewer bucket digits")
    class_off, acc = {}, 0
    for r in sorted(totals, key=lambda r: r[0]):
        class_off[r[0]] = acc
        acc += r[1]
    keyed = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, bucket_digits))
    per_bucket = keyed.groupBy(class_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    off_map = F.create_map(*[x for c, o in class_off.items() for x in (F.lit(c), F.lit(o))])
    if not class_off:
        return unlabelled
    # Range start positions inside each class: prefix sums over ≤ 16**digits rows per class.
    w_range = Window.partitionBy(class_col).orderBy("_b")
    starts = per_bucket.select(
        class_col, "_b",
        (F.element_at(off_map, F.col(class_col)) + F.sum("_n").over(w_range) - F.col("_n")).alias("_start"))
    w_row = Window.partitionBy(class_col, "_b").orderBy("_h", id_col)
    return (keyed.join(F.broadcast(starts), [class_col, "_b"])
            .withColumn(FOLD, ((F.col("_start") + F.row_number().over(w_row) - 1) % k).cast("int"))
            .drop("_h", "_b", "_start").unionByName(unlabelled))


def assign_folds(df: DataFrame, k: int = 7, seed: int = 42, labels: Sequence[str] = LABELS,
                 id_col: str = COMMENT_ID, bucket_digits: int | None = None) -> DataFrame:
    """D1 + D2: code the label rows and stratify on the code."""
    return stratified_folds(df.withColumn(CODE, label_code(labels)), k=k, seed=seed,
                            id_col=id_col, bucket_digits=bucket_digits)


def train_rows(df: DataFrame, k: int) -> DataFrame:
    """Rows outside fold ``k``; a null fold counts as training data."""
    return df.where(~F.col(FOLD).eqNullSafe(F.lit(k)))


def valid_rows(df: DataFrame, k: int) -> DataFrame:
    """Rows of fold ``k``."""
    return df.where(F.col(FOLD) == F.lit(k))


def split_fold(df: DataFrame, k: int, drop: Sequence[str] = (COMMENT_ID,)) -> tuple[DataFrame, DataFrame]:
    """``(train, dev)`` for fold ``k`` with ``fold`` and the id dropped."""
    cols = [FOLD, *drop]
    return train_rows(df, k).drop(*cols), valid_rows(df, k).drop(*cols)


def write_folded(df: DataFrame, path: str) -> None:
    """S2 without k copies: each row once, in its fold's partition. Folds that ``df`` has
    replace those of an earlier write, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLD).parquet(path)


def read_folded(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table that ``write_folded`` made of ``like``; ``train_rows`` and ``valid_rows`` read their partitions only."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def class_distribution(df: DataFrame, class_col: str = CODE) -> DataFrame:
    """A3: rows per class."""
    return df.groupBy(class_col).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


def fold_class_counts(df: DataFrame, class_col: str = CODE) -> DataFrame:
    return df.groupBy(FOLD, class_col).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
