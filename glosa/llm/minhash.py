"""Operator 4: near-duplicate groups by SuperMinHash signatures.

1. Every document becomes its set of distinct word shingles (64-bit hashes of
   64-bit word hashes). Documents with equal sets form a class, so copies are
   never compared with each other.
2. A class gets a SuperMinHash signature. Each element visits the signature's
   slots in an order drawn by a Fisher-Yates shuffle seeded by the element; its
   value in the slot of its j-th visit lies in [j, j + 1). The visits of one
   element are therefore spread over all slots (lower variance than independent
   hashes), and a slot filled at visit j cannot be improved at a later one: a
   document stops once all its slots are filled.
3. Bands of ``rows`` slots put classes into buckets. ``rows`` is fixed and the
   number of bands follows from the threshold so that a pair at the threshold
   is missed with a probability of at most ``miss``.
4. Buckets are verified on the full sets in three rounds. A round picks pivots
   in each bucket (1, about 16 by a priority fixed per class, so buckets with the
   same members pick the same, and then all that could link with any that is left;
   the class with the fewest shingles of its own is one) and compares them with the
   bucket's members of other components. A pivot that was compared leaves the
   bucket; a bucket whose members share one component is done. All pairs that could
   still link two components get compared, but pairs inside a component never are,
   nor are pairs without a rare shingle in common whose other shingles are too few.
   Of two such classes that link at least one has few rare shingles (``_light``), so
   the last round's pivots are those, and look-alike pages with much of their own
   never meet. A large bucket's members are dealt over several tasks.
5. Links are grouped by union-find: within each partition at first, then by
   large-star and small-star rounds over the remaining forest.

Texts are read whole. A null or empty text has no shingles and no links. A
repeated row is a copy of its own. A null id takes part, but never names a
component unless all ids of the component are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import drop_stored, slices, stored

SLICE_BYTES = 2_000_000
RARE = 8
PIVOTS = (1, 16, None)  # pivots a bucket in each round; None: all light ones that are left
SALT_ROWS = 1024  # members of a bucket that one task compares with its pivots
UNFILLED = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased).

    A text of fewer than ``k`` words, but not none, is one shingle.
    """
    factors, out = _odd(k, 17), []
    for text in texts:
        words = text.lower().split() if text else []
        n = len(words)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        width = min(n, k)
        acc = hashes[: n - width + 1] * factors[0]
        for j in range(1, width):
            acc = acc + hashes[j: n - width + 1 + j] * factors[j]
        shingles = np.sort(_mix(acc + np.uint64(width)))
        if len(shingles) > 1:
            shingles = shingles[np.concatenate(([True], shingles[1:] != shingles[:-1]))]
        out.append(shingles)
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` slots per (non-empty) set.

    A slot holds ``step << 32 | random bits``, the fixed-point form of step + r.
    """
    sig = np.full((len(sets), m), UNFILLED, np.uint64)
    if not sets:
        return sig
    flat = sig.reshape(-1)
    elements = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None  # the elements' shuffles, kept from the third step on
    first = second = None
    for step in range(m):
        draw = _mix(elements + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (draw >> np.uint64(32)) | np.uint64(step << 32)
        k = step + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - step)) >> np.uint64(32)).astype(np.int64)
        if step == 0:
            slot = first = k
        elif step == 1:
            slot, second = np.where(k == first, 0, k), k
        else:
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
                rows = np.arange(len(elements))
                for i, ki in ((0, first), (1, second)):
                    held = order[rows, ki]
                    order[rows, ki] = order[:, i]
                    order[:, i] = held
            rows = np.arange(len(elements))
            slot = order[rows, k]
            order[rows, k] = order[:, step]
            slot = slot.astype(np.int64)
        at = doc * m + slot
        if step == 0:
            np.minimum.at(flat, at, value)
        else:
            late = np.flatnonzero(flat[at] > np.uint64(step << 32))  # filled at this step or not at all
            np.minimum.at(flat, at[late], value[late])
        open_docs = (sig == UNFILLED).any(axis=1)
        if not open_docs.any():
            break
        keep = open_docs[doc]
        if step < 2 or keep.sum() < 0.7 * len(keep):
            elements, doc = elements[keep], doc[keep]
            first, second = first[keep], None if second is None else second[keep]
            order = None if order is None else order[keep]
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` slots; the band's number is part of it."""
    n, m = sig.shape
    bands = m // rows
    acc = (sig[:, : bands * rows].reshape(n, bands, rows) * _odd(rows, 29)).sum(axis=2, dtype=np.uint64)
    return _mix(acc + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """Bands so that a pair of this similarity shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def _sign(k: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(part.column("text").to_pylist(), k)
            full = [s for s in sets if len(s)]
            keys = band_keys(superminhash(full, bands * rows), rows)
            keys, at = [*keys], iter(range(len(full)))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("row_hash"),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([keys[next(at)] if len(s) else None for s in sets], pa.list_(pa.int64()))],
                names=["id", "row_hash", "n_shingles", "set_key", "bands"])
    return run


def _sets_of(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(part.column("text").to_pylist(), k)
            same = [xxhash.xxh3_128_digest(s.tobytes()) == key
                    for s, key in zip(sets, part.column("set_key").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "shingles"]).filter(pa.array(same, pa.bool_()))
    return run


def _confirm(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keep the pairs with den * |A ∩ B| >= num * |A ∪ B|."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(part.column("x"), part.column("y"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: a link from each node to its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for part in batches:
        for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        some = nodes[i: i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in some], pa.int64()), pa.array(some, pa.int64())],
                                         names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, component) with the least node as name.

    Nodes that are their component's name have no row. Large-star and
    small-star rounds go on until each node hangs on one name directly.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
                   .mapInArrow(_forest, "a long, b long"), "forest")
    while not _tangled(links).isEmpty():
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.least("a", "m").alias("a"), "b")
        large = stored(large.where("a < b").distinct(), "large")
        drop_stored(links)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        links = stored(small.where("a < b").distinct(), "small")
        drop_stored(large)
    return links.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _tangled(links: DataFrame) -> DataFrame:
    """Nodes that hang on several names, or that are a name and hang on another."""
    ends = links.select(F.col("b").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("names")).unionAll(
        links.select(F.col("a").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("names")))
    return (ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("names").alias("names"))
            .where("hangs > 1 or (hangs = 1 and names = 1)"))


def _sets(docs: DataFrame, classes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the classes that share a bucket, from one row of each class."""
    wanted = classes.join(members.select("node").distinct(), "node").select("node", "set_key", "row_hash")
    rows = docs.join(wanted, "row_hash").select("node", "set_key", "text")
    return rows.mapInArrow(_sets_of(k), "node long, shingles binary").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5,
                    num: int = 80, den: int = 100, rows: int = 6, miss: float = 1e-6) -> DataFrame:
    """Near-duplicate components of whole texts.

    Two documents link when ``den * |A ∩ B| >= num * |A ∪ B|`` over their
    ``shingle``-word sets. Returns one row per input row: the id column,
    ``n_shingles``, ``class_size`` (rows with the same set; null without
    shingles), ``component_id`` (least id of the component), ``kept`` (the id
    equals it), ``row_hash`` (of id and text) and ``stays`` (the row is its
    component's first by id, nulls last, and row_hash). An empty table gives no
    rows.
    """
    bands = bands_for(num / den, rows, miss)
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_hash"),
                       F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    signed = stored(docs.mapInArrow(_sign(shingle, bands, rows),
                                    f"id {kind}, row_hash long, n_shingles long, set_key binary, bands array<long>"),
                    "signed")
    classes = stored(signed.where("set_key is not null").groupBy("set_key")
                     .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_hash")).alias("first"),
                          F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("class_size"),
                          F.first("bands").alias("bands"))
                     .withColumn("row_hash", F.col("first.row_hash"))
                     .withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select(F.explode("bands").alias("bucket"), "node", F.col("n").alias("n"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    members = stored(banded.join(shared, "bucket"), "members")
    named = classes.select("node", "first", "set_key", "class_size")
    if not members.isEmpty():
        labels = _verified(docs, classes, members, shingle, num, den)
        named = (named.join(labels, "node", "left")
                 .withColumn("component", F.coalesce("component", "node")))
        # Stored, so that the join reads two plain exchanges and can split a hot component.
        least = stored(named.groupBy("component").agg(F.min("first").alias("name")), "least")
        named = named.join(least, "component")
    else:
        named = named.withColumn("name", F.col("first"))
    out = signed.select("id", "row_hash", "n_shingles", "set_key").join(
        named.select("set_key", "class_size", "name"), "set_key", "left")
    alone = F.col("set_key").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("name.id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "class_size", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), "row_hash",
                      (alone | (F.col("row_hash") == F.col("name.row_hash"))).alias("stays"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows without their near duplicates: of each component the row that names it.

    Of rows with that row's id and text one stays, the one with the least hash of
    all columns. Rows without shingles stay, equal ones once.
    """
    stay = near_duplicates(docs, id_col, text_col, **options).where("stays").select(
        F.col(id_col).alias("stay_id"), F.col("row_hash").alias("stay_hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"),
                       F.xxhash64(id_col, text_col).alias("row_hash"), F.xxhash64(*docs.columns).alias("order"))
    rows = rows.join(stay, (F.col("row_hash") == F.col("stay_hash")) & F.col("id").eqNullSafe(F.col("stay_id")), "left_semi")
    return rows.groupBy("row_hash", "id").agg(F.min_by("row", "order").alias("row")).select("row.*")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for node, value in zip(part.column("node").to_pylist(), part.column("shingles"), strict=True):
            shingles = np.frombuffer(value.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shingles), node)), pa.array(shingles)],
                                             names=["node", "shingle"])


def _rare_shingles(state: DataFrame, sets: DataFrame) -> DataFrame:
    """(shingle, node, df) of the shingles that at most RARE of the open buckets' classes have."""
    rows = sets.join(state.select("node").distinct(), "node").mapInArrow(_shingles, "node long, shingle long")
    few = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= RARE)
    return stored(rows.join(few, "shingle"), "rare")


def _sharing(rare: DataFrame, state: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes of different components and like sizes that share a rare shingle: RARE partners a shingle at most."""
    nodes = state.select("node", "n", "component").distinct()
    held = rare.where("df > 1").join(nodes, "node")
    other = held.select("shingle", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("component").alias("pc"))
    return (held.join(other, "shingle").where("node < p and component <> pc")
            .where(F.lit(den) * F.least("n", "pn") >= F.lit(num) * F.greatest("n", "pn"))
            .select(F.col("p").alias("a"), F.col("node").alias("b")).distinct())


def _light(num: int, den: int) -> Column:
    """Classes with few rare shingles of their own.

    Two classes without a rare shingle in common share m = min(n - own, pn - po)
    at most, and link only if (den + num) * m >= num * (n + pn). As
    2 * m <= n - own + pn - po, that needs
    (den + num) * (own + po) <= (den - num) * (n + pn): not both exceed their part.
    """
    return F.lit(den + num) * F.col("own") <= F.lit(den - num) * F.col("n")


def _verified(docs: DataFrame, classes: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, component) after all needed comparisons within the buckets.

    After the first round, pairs that share a rare shingle are compared through
    an index of those. The others have no rare shingle in their intersection,
    and are compared only if their other shingles could reach the threshold.
    """
    sets = stored(_sets(docs, classes, members, k), "sets")
    labels = None
    members = members.withColumn("own", F.lit(0).cast("long"))
    # A class's place in [0, 1) by a hash of its number: the same in all buckets.
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for i, pivots in enumerate(PIVOTS):
        if labels is None:
            state = members.withColumn("component", F.col("node"))
        else:
            state = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # Stored, like the names above: a hot bucket's rows are split.
        open_buckets = (state.groupBy("bucket")
                        .agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.col("own") / F.col("n"), "node")).alias("least"),
                             F.min("component").alias("c0"), F.max("component").alias("c1"))
                        .where("c0 < c1").select("bucket", "size", F.col("least.node").alias("least")))
        open_buckets = stored(open_buckets, "open")
        chosen = _light(num, den) if pivots is None else (
            (F.col("node") == F.col("least")) | (place * F.col("size") < F.lit(float(pivots))))
        state = stored(state.join(open_buckets, "bucket").withColumn("pivot", chosen), "state")
        drop_stored(members)
        drop_stored(open_buckets)
        if state.isEmpty():
            break
        sharing = None
        if i == 1:
            rare = _rare_shingles(state, sets)
            sharing = _sharing(rare, state, num, den)
            own = rare.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
            open_of = state.groupBy("node").agg(F.collect_list("bucket").alias("open"))
            state = stored(state.drop("own").join(open_of.join(own, "node", "left"), "node").na.fill(0, ["own"]), "state")
        # A bucket's members are dealt over ``parts`` tasks, each with all of its pivots.
        parts = F.ceil(F.col("size") / F.lit(float(SALT_ROWS))).cast("int")
        pivot = state.where("pivot").select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
                                            F.col("node").alias("p"), F.col("n").alias("pn"),
                                            F.col("own").alias("po"), F.col("component").alias("pc"),
                                            *[F.col("open").alias("popen") for c in state.columns if c == "open"])
        both = F.least(F.col("n") - F.col("own"), F.col("pn") - F.col("po"))
        dealt = state.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
        pairs = (dealt.join(pivot, ["bucket", "part"]).where("component <> pc")
                 .where(F.lit(den) * both >= F.lit(num) * (F.col("n") + F.col("pn") - both))
                 .where("not pivot or node < p"))
        if "open" in state.columns:  # a pair is compared in the first bucket it shares
            pairs = pairs.where(F.col("bucket") == F.array_min(F.array_intersect("open", "popen")))
        pairs = pairs.select(F.col("p").alias("a"), F.col("node").alias("b"))
        pairs = (pairs if sharing is None else pairs.unionAll(sharing)).distinct()
        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        found = stored(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
                       .mapInArrow(_confirm(num, den), "a long, b long"), "links")
        if not found.isEmpty():
            known = found if labels is None else found.unionAll(labels.select(F.col("component").alias("a"), F.col("node").alias("b")))
            labels = components(known)
        members = state.where("not pivot").drop("component", "size", "least", "pivot")
    drop_stored(sets)
    return labels if labels is not None else classes.select("node", F.col("node").alias("component")).limit(0)
