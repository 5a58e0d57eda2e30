"""Operator 8: mix sources to target weights by Pareto order sampling.

A source's target in words is its share of all words by weight, at most
``max_copies`` times its own size; what is cut off goes to the others by
weight. target / size = whole copies + fraction: each document of the source is
taken that many whole times for certain, and a sample adds one more copy of
some. Of a document, with u uniform from a hash of its id,

    rank = (u / (1 - u)) / inclusion odds,   odds = fraction / (1 - fraction) * sqrt(size)

and the sample is the documents of lowest rank, as many as fill the words that
are wanted: a sample of fixed size, in words, with unequal probabilities. The
fraction is the same for all of a source and cannot change the order, so ranks
are computed without it. The document in which the sample ends does not fit; up
to three others, whose sizes come nearest to the words still missing, take its
place.

A source is never gathered in one place: sums over 1,024 slices of the ranks,
and over 1,024 slices of the one in which a source's sample ends, leave about a
millionth of a source to be sorted.

Built-in functions only. Sources go by code point, null last, and are ranked in
one task, a row each. Rows that agree in source, id and size are one unit with a
count and can be taken in part. A null text has size 0; a size of 0 takes
nothing; a null id is an id like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosa.llm.common import n_words, stored

SLICES = 1024
TOP_UPS = 3


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source."""
    ranked = totals.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.lit(max_copies) * F.col("source_size"))
    # By the size a unit of weight may ask for, the sources that reach their limit come first.
    by_room = W.orderBy((F.col("most") / F.col("weight")).asc(), "place")
    before = F.coalesce(F.sum("most").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_room.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = W.partitionBy()
    ranked = ranked.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    capped = F.col("level") * F.col("weight") > F.col("most")
    ranked = ranked.withColumn("capped", capped).withColumn(
        "level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def _uniform(id_col: str, seed: int) -> Column:
    """A number inside (0, 1) from the first 52 bits of an MD5 sum."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _ranked(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """The input row as a struct and source, id, size, rank."""
    docs = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"),
                       n_words(F.col(text_col)).alias("size"))
    u = _uniform("id", seed)
    return docs.withColumn("rank", F.when(F.col("size") > 0, u / (1 - u) / F.sqrt("size")))


def _plan(ranked: DataFrame, weights: tuple[int, ...], max_copies: int) -> tuple[DataFrame, DataFrame]:
    """Units and the decision for each source.

    Units: source, id, size, rank, n, at (the rank's place in [0, 1)). Decisions:
    source, source_size, target, copies, wanted (words of the sample), low and
    high (the places between which the sample ends; null if it takes all) and
    filled (words of the units below them).
    """
    units = stored(ranked.groupBy("source", "id", "size", "rank").agg(F.count(F.lit(1)).alias("n")), "units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                         F.sum("n").alias("source_docs"))
    sources = _with_source(targets(totals.drop("source_docs"), weights, max_copies),
                           totals.select("source", "source_docs"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("copies", F.least(F.floor(ratio), F.lit(max_copies)).cast("long"))
    sources = sources.withColumn("wanted", F.col("target") - F.col("copies") * F.col("source_size"))
    sources = stored(sources.withColumn("low", F.lit(0.0)).withColumn("high", F.lit(1.0))
                     .withColumn("filled", F.lit(0).cast("long")), "sources")
    units = _with_source(units, sources.select("source", "source_size", "source_docs"))
    # Ranks in units of a mean document's: half of such documents are below 1/2.
    scaled = F.col("rank") * F.sqrt(F.col("source_size") / F.col("source_docs"))
    units = units.withColumn("at", F.least(scaled / (1 + scaled), F.lit(1 - 2.0**-40))).drop("source_size", "source_docs")
    for parts in (SLICES, SLICES**2):
        sources = stored(_narrowed(units, sources, parts), "narrowed")
    return units, sources


def _narrowed(units: DataFrame, sources: DataFrame, parts: int) -> DataFrame:
    """Decisions with low, high and filled moved to the slice, of ``parts``, in which the sample ends."""
    inside = _with_source(units.where("size > 0"), sources.select("source", "low", "high"))
    inside = inside.where("at >= low and at < high").withColumn("slice", F.floor(F.col("at") * parts))
    slices = inside.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    upto = F.col("filled") + F.sum("words").over(W.partitionBy("source").orderBy("slice"))
    slices = _with_source(slices, sources.select("source", "filled", "wanted")).withColumn("upto", upto)
    found = slices.groupBy("source").agg(
        F.min(F.when(F.col("upto") > F.col("wanted"), F.col("slice"))).alias("cut"),
        F.max(F.when(F.col("upto") <= F.col("wanted"), F.col("upto"))).alias("below")).withColumnRenamed("source", "s")
    sources = sources.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return (sources.withColumn("low", F.col("cut") / F.lit(float(parts)))
            .withColumn("high", (F.col("cut") + 1) / F.lit(float(parts)))
            .withColumn("filled", F.coalesce("below", "filled")).drop("cut", "below"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join a column set of one row per source; a hot source is split by the skew join."""
    sources = sources.withColumnRenamed("source", "of")
    return rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _cut(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Decisions with the unit in which each sample ends (``last``) and its top-ups (``more1``...), null where none."""
    in_cut = _with_source(units.where("size > 0"), sources.select("source", "low", "high", "filled", "wanted"))
    in_cut = in_cut.where("at >= low and at < high")
    order = W.partitionBy("source").orderBy("rank", F.col("id").asc_nulls_last(), "size")
    before = F.col("filled") + F.coalesce(
        F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fits = F.least(F.floor((F.col("wanted") - F.col("before")) / F.col("size")), F.col("n")).cast("long")
    in_cut = in_cut.withColumn("before", before).withColumn("fits", fits)
    # The first unit that does not fit wholly ends the sample.
    last = (in_cut.where("fits < n").groupBy("source")
            .agg(F.min_by(F.struct("rank", "id", "size", "n", "fits", "before"), F.struct("before", "rank")).alias("last"))
            .select(F.col("source").alias("s"), "last",
                    (F.col("last.before") + F.col("last.fits") * F.col("last.size")).alias("got")))
    sources = sources.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    sources = sources.withColumn("missing", F.col("wanted") - F.coalesce("got", "wanted"))
    for k in range(1, TOP_UPS + 1):
        taken = [f"more{i}" for i in range(1, k)]
        free = _with_source(units.where("size > 0"),
                            sources.where("last is not null").select("source", "last", "missing", *taken))
        # Nearer than nothing; only the last may go beyond what is missing.
        near = F.abs(F.col("size") - F.col("missing")) < F.col("missing")
        fits = near if k == TOP_UPS else near & (F.col("size") <= F.col("missing"))
        free = free.where(fits & (_place() >= _place("last")))
        for c in taken:
            free = free.where(F.col(c).isNull() | (_place() != _place(c)))
        best = F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), "rank", "id", "size"))
        more = free.groupBy("source").agg(best.alias(f"more{k}")).withColumnRenamed("source", "s")
        sources = stored(sources.join(more, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn(
            "missing", F.col("missing") - F.coalesce(F.col(f"more{k}.size"), F.lit(0))), "topped")
    return sources


def _place(of: str = "") -> Column:
    """What units are ordered by, as a struct."""
    of = f"{of}." if of else ""
    return F.struct(F.col(f"{of}rank").alias("rank"), F.col(f"{of}id").isNull().alias("no_id"),
                    F.col(f"{of}id").alias("id"), F.col(f"{of}size").alias("size"))


def _extra() -> Column:
    """How many rows of a unit the sample takes once more."""
    sampled = (F.when((F.col("wanted") <= 0) | (F.col("size") <= 0), F.lit(0))
               .when(F.col("last").isNull() | (_place() < _place("last")), F.col("n"))
               .when(_place() == _place("last"), F.col("last.fits")).otherwise(F.lit(0)))
    for k in range(1, TOP_UPS + 1):
        sampled = sampled + F.when(F.col(f"more{k}").isNotNull() & (_place() == _place(f"more{k}")), 1).otherwise(0)
    return sampled.cast("long")


DECISION = ["source", "source_size", "target", "copies", "wanted", "last", *[f"more{k}" for k in range(1, TOP_UPS + 1)]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
        weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies and ``taken`` (copies * size).

    An empty table gives no rows.
    """
    units, sources = _plan(_ranked(docs, id_col, text_col, source_col, seed).drop("row"), weights, max_copies)
    decided = _cut(units, sources)
    units = _with_source(units, decided.select(*DECISION))
    units = units.withColumn("extra", _extra())
    rows = units.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    copies = F.col("copies") + F.when(F.col("k") <= F.col("extra"), 1).otherwise(0)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"),
                       (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
                    weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: the input rows, each as often as it is taken.

    No join on documents: a row's copies follow from its source's decision. Rows
    of one unit are told apart by nothing, so a unit that is taken in part is
    taken whole if at least half of it is wanted.
    """
    ranked = _ranked(docs, id_col, text_col, source_col, seed)
    units, sources = _plan(ranked.drop("row"), weights, max_copies)
    decided = _cut(units, sources)
    rows = _with_source(ranked, decided.select(*DECISION))
    # A row stands for itself here; one of the last unit is taken if half of that unit fits.
    rows = rows.withColumn("n", F.lit(1)).withColumn(
        "last", F.when(F.col("last").isNotNull(), F.col("last").withField(
            "fits", F.when(2 * F.col("last.fits") >= F.col("last.n"), F.lit(1)).otherwise(F.lit(0)).cast("long"))))
    copies = F.least(F.col("copies") + _extra(), F.lit(max_copies).cast("long"))
    rows = rows.select("row", copies.cast("int").alias("copies")).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
