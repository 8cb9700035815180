"""Near-duplicate detection with DartMinHash signatures.

A text is a weighted set of word shingles (weight 1 each, or its count). Each
element owns a half plane of weight by rank, cut into unit regions. Seeded by
the element and the region, darts hit a region as a Poisson process; a dart
counts if the element's weight reaches its layer. Every dart names a coordinate,
and each coordinate keeps its earliest dart, so two sets agree on a coordinate
with probability equal to their weighted Jaccard similarity. Only ranks up to
t (ln t + 3) / total weight are thrown, which fills the signature for almost
all sets in time independent of t times their size; the rest throw again with
twice the rank.

Bands of the signature are joined; every candidate pair is settled on the true
similarity. Within a bucket, pairs are formed between members of different
components only and a growing number of centres (1, 8, 64, ...), until a bucket
lies in one component or all its pairs are settled. Shingles that one candidate
alone has bound the similarity it can reach (f shared ones of n: at most
f / (n + m - f) with a text of m), and so do bit arrays of both texts' shingles;
pairs that stay below the threshold are not formed. No link between components
is lost, and a group of thousands of near copies costs a few pairs a member.

With 32 bands of 4, a pair of similarity 0.8 is missed with probability 5e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from . import textkernels as T
from .components import components
from .scratch import packed, ship, spread, stored, unpacked

LAST = (1 << 63) - 1
#: Pairs of a bucket's members that a task compares, about, and places of a bucket that a task takes.
PAIRS, PLACES = 200_000, 1_000
MARK_WORDS = 16  # 64-bit words of the bit array that marks a text's shingles
LAYER, CELL, DART = T.U(0xA24BAED4963EE407), T.U(0x9FB21C651E98DF25), T.U(0xD6E8FEB86659FD93)


class _Shingles:
    """Distinct (row, shingle, layer) of a slice in row order, and a content hash for each row."""

    def __init__(self, column: pa.Array, words: int, by_count: bool):
        hashes, at = T.word_hashes(column, T.byte_class(T.SPACES), lower=True)
        grams, counts = T.Grams(hashes), np.diff(at)
        rows, starts = T.window_starts(at, words)
        short = np.flatnonzero((counts > 0) & (counts < words))
        h = np.concatenate([grams.runs(starts, np.full(len(starts), words)), grams.runs(at[short], counts[short])])
        rows = np.concatenate([rows, short])
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        if by_count:
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(h)))
            self.row, self.element = rows, T.mix(h + (np.arange(len(h)) - np.repeat(first, size)).astype(T.U) * LAYER)
        else:
            self.row, self.element = rows[new], h[new]
        self.size = np.bincount(self.row, minlength=len(counts))
        self.c1, self.c2 = grams.runs(at[:-1], counts), grams.runs(at[:-1], counts, 1)


def _throw(row: np.ndarray, element: np.ndarray, reach: np.ndarray, t: int, ranks: np.ndarray, darts: np.ndarray) -> None:
    """Darts of the elements with rank below reach[row]; earliest per coordinate into ranks and darts."""
    cells = np.ceil(reach[row]).astype(np.int64)
    owner = np.repeat(np.arange(len(row)), cells)
    cell = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
    row, seed = row[owner], T.mix(element[owner] + cell.astype(T.U) * CELL)
    room = np.minimum(1.0, reach[row] - cell)
    rank, k = cell.astype(float), 0
    while len(seed):
        k += 1
        u = ((T.mix(seed + T.U(k * int(DART) % (1 << 64))) >> T.U(11)).astype(float) + 0.5) * 2.0**-53
        hit = np.flatnonzero(u > np.exp(-room))
        gap = -np.log(u[hit])
        row, seed, room, rank = row[hit], seed[hit], room[hit] - gap, rank[hit] + gap
        dart = T.mix(seed ^ T.U(k))
        slot = row * t + (dart % T.U(t)).astype(np.int64)
        np.minimum.at(ranks, slot, rank)
        won = np.flatnonzero(ranks[slot] == rank)
        darts[slot[won]] = dart[won]


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, t: int) -> np.ndarray:
    """A (rows, t) array of dart names; rows of weight 0 are all 0."""
    n = len(weight)
    ranks, darts = np.full(n * t, np.inf), np.zeros(n * t, T.U)
    reach = np.where(weight > 0, t * (np.log(t) + 3) / np.maximum(weight, 1), 0.0)
    open_rows = weight > 0
    while open_rows.any():
        take = open_rows[row]
        _throw(row[take], element[take], reach, t, ranks, darts)
        open_rows &= np.isinf(ranks.reshape(n, t)).any(axis=1)
        reach = reach * 2
    return darts.reshape(n, t)


def _signing(words: int, by_count: bool, bands: int, rows_per_band: int):
    t = bands * rows_per_band

    def kernel(batches):
        for whole in batches:
            for batch in T.slices(whole, "_text", rows=200):
                x = _Shingles(batch.column("_text"), words, by_count)
                sig = signatures(x.row, x.element, x.size, t).reshape(batch.num_rows, bands, rows_per_band)
                key = np.broadcast_to(np.arange(bands, dtype=T.U), sig.shape[:2]).copy()
                for k in range(rows_per_band):
                    key = T.mix(key * LAYER + sig[:, :, k])
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id"), pa.array(T.signed(x.c1)), pa.array(T.signed(x.c2)), pa.array(x.size.astype(np.int32)),
                    T.list_array(np.full(batch.num_rows, bands), pa.array(T.signed(key.ravel()))),
                ], ["_id", "c1", "c2", "n", "bands"])

    return kernel


def _listing(words: int, by_count: bool, wanted: T.Bitmap):
    def kernel(batches):
        for whole in batches:
            for batch in T.slices(whole, "_text"):
                x = _Shingles(batch.column("_text"), words, by_count)
                ids = np.asarray(batch.column("_id")).astype(T.U)
                take = wanted.holds(x.c1 ^ ids)
                rows = np.flatnonzero(take)
                mine = take[x.row]
                marks = np.zeros((batch.num_rows, MARK_WORDS), T.U)
                slot = x.element[mine] % T.U(64 * MARK_WORDS)
                np.bitwise_or.at(marks, (x.row[mine], (slot >> T.U(6)).astype(np.int64)), T.U(1) << (slot & T.U(63)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id").take(pa.array(rows)), pa.array(T.signed(x.c1[rows])), pa.array(T.signed(x.c2[rows])),
                    T.list_array(x.size[rows], pa.array(T.signed(x.element[mine]))),
                    T.list_array(np.full(len(rows), MARK_WORDS), pa.array(T.signed(marks[rows].ravel()))),
                ], ["_id", "c1", "c2", "shingles", "marks"])

    return kernel


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    counted = pairs.join(left, "u").join(right, "v").select("u", "v", both.alias("i"), (F.size("_a") + F.size("_b")).alias("s"))
    return counted.where(F.col("i") >= threshold * (F.col("s") - F.col("i")) - 1e-9).select("u", "v")


def _lacking(a: str, b: str):
    """How many marks of ``a`` are not in ``b``: as many shingles of the first text, at least, are not in the second."""
    words = [F.bit_count(F.get(a, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(k))))) for k in range(MARK_WORDS)]
    return sum(words[1:], words[0])


def _alone(sets: DataFrame) -> DataFrame:
    """(node, alone): how many of a node's shingles no other candidate has. They cannot be shared with a partner."""
    each = sets.select("node", F.explode("shingles").alias("s"))
    once = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8,
                 by_count: bool = False, bands: int = 32, rows_per_band: int = 4, bits: int | None = None, growth: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, class_id, class_size, kept, and _th (a hash of the text).

    Words are runs without white space, A-Z lower-cased; a text of fewer than
    ``words`` words is one shingle. Texts of equal words are copies of each other
    and share a class, as do texts linked, directly or not, by a similarity of
    ``threshold`` or more. class_id is the least id of the class, class_size its
    rows; the first row with the least id is kept. Null ids count as larger than
    any other. Texts without words (null, empty) have no similarity: copies of
    "no words" form one class only if their texts are equal. Repeated rows are
    copies. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # A Python step needs the text; its hash tells wordless texts apart and lets callers find their rows again.
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), text.alias("_text"))
    rows = stored(
        docs.select(
            F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("i"), F.xxhash64(text).alias("h")).alias("_id"),
            text.alias("_text"),
        ).mapInArrow(
            _signing(words, by_count, bands, rows_per_band),
            "_id struct<i:bigint,h:bigint>, c1 bigint, c2 bigint, n int, bands array<bigint>",
        ).select(
            F.col("_id.i").alias("_id"), F.col("_id.h").alias("_th"), F.monotonically_increasing_id().alias("_row"),
            F.when(F.col("n") > 0, F.col("c1")).otherwise(F.col("_id.h")).alias("c1"), "c2", "n", "bands",
        ), "signatures")
    texts = stored(
        rows.groupBy("c1", "c2", "n").agg(
            F.min(F.struct("_id", "_row")).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")
        ).withColumn("node", F.monotonically_increasing_id()), "texts")

    keys = texts.where("n > 0").select("node", "n", F.explode("bands").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets", few=True)
    # A member's place in its bucket of m, from its hash: about one member a place, without sorting the bucket.
    spot = F.xxhash64("node").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    members = stored(keys.join(shared, "key").select("key", "node", "n", (F.floor(spot * F.col("m")) + 1).alias("place")), "members")

    candidates = texts.join(members.select("node").distinct(), "node", "left_semi").select("node", "c1", "c2", F.col("first._id").alias("_id"))
    candidates = stored(candidates, "candidates", few=True)
    wanted = T.collect_bitmap(candidates.select(F.col("c1").bitwiseXOR(F.col("_id")).alias("k")), "k", bits)
    sets = stored(
        slim.mapInArrow(_listing(words, by_count, wanted), "_id bigint, c1 bigint, c2 bigint, shingles array<bigint>, marks array<bigint>")
        .join(candidates, ["_id", "c1", "c2"]).select("node", "shingles", "marks").dropDuplicates(["node"]), "sets")

    able = sets.select("node", "marks").join(stored(_alone(sets), "alone", few=True), "node", "left").select("node", "marks", F.coalesce("alone", F.lit(0)).alias("alone"))
    members = stored(
        members.join(able, "node").withColumn("f", F.col("n") - F.col("alone")).where(F.col("f") >= threshold * F.col("n") - 1e-9)
        .select("key", "node", "n", "f", "marks", "place"), "able")

    roots, now, low, high = None, members.withColumn("root", F.col("node")), 0, 1
    while True:
        split = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("place").alias("most"), F.count(F.lit(1)).alias("m"))
        split = stored(split.where(F.col("x") < F.col("y")).where(F.col("most") > low).select("key", "most", "m"), "split", few=True)
        work = split.agg(F.sum(F.col("m") * F.least(F.lit(high), "m"))).first()[0]
        if work is None:
            break
        # Buckets are few bytes and much work: tasks are counted by pairs, and a large bucket is cut into chunks of its places.
        tasks, chunk = int(work) // PAIRS + 1, lambda place: F.floor((place - 1) / PLACES)
        dealt = lambda df: df.repartition(tasks, "key", "chunk")  # noqa: E731, B023
        active = now.join(split, "key").where(F.col("place") > low)
        centres = active.where(F.col("place") <= high).select(
            "key", F.col("node").alias("c"), F.col("root").alias("c_root"), F.col("n").alias("c_n"), F.col("f").alias("c_f"),
            F.col("place").alias("c_place"), F.col("marks").alias("c_marks"), F.explode(F.sequence(F.lit(0).cast("long"), chunk(F.col("most")))).alias("chunk"))
        active = active.select("key", "node", "root", "n", "f", "marks", "place", chunk(F.col("place")).alias("chunk"))
        most = F.least("f", "c_f", F.col("n") - _lacking("marks", "c_marks"), F.col("c_n") - _lacking("c_marks", "marks"))
        pairs = dealt(active).join(dealt(centres), ["key", "chunk"]).where(
            (F.col("root") != F.col("c_root")) & (F.struct("place", "node") > F.struct("c_place", "c"))
            & (most >= threshold * (F.col("n") + F.col("c_n") - most) - 1e-9)
        ).select(F.greatest("node", "c").alias("u"), F.least("node", "c").alias("v")).distinct()
        links = stored(spread(_linked(pairs, sets, threshold)), "links")
        low, high = high, high * growth
        if links.isEmpty():
            continue
        edges = links if roots is None else links.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = stored(components(edges), "roots", few=True)
        now = stored(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled", few=True)
    classed = texts.select("node", "first", "copies", "c1", "c2", F.col("n").alias("t_n"))
    if roots is not None:
        classed = classed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        classed = classed.withColumn("root", F.col("node"))
    heads = stored(classed.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size")), "heads", few=True)
    of_text = stored(classed.join(heads, "root").select("c1", "c2", F.col("t_n").alias("n"), "head", "class_size"), "classes")
    number = F.when(F.col("head._id") != LAST, F.col("head._id")).cast(kind)
    return rows.select("_id", "_th", "_row", "c1", "c2", "n").join(of_text, ["c1", "c2", "n"]).select(
        F.when(F.col("_id") != LAST, F.col("_id")).cast(kind).alias(id_col), number.alias("class_id"), "class_size",
        (F.col("_row") == F.col("head._row")).alias("kept"), "_th")


def _flagging(names: list[str], wanted: T.Bitmap):
    def kernel(batches):
        for batch in batches:
            maybe = wanted.holds(np.asarray(batch.column("key")).view(T.U))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*names, "maybe"])

    return kernel


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, **options) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns, of any name (see ``near_classes``).

    Only rows that a bit array names as perhaps dropped are shuffled, to settle it
    by an anti-join on id and text hash.
    """
    classes = stored(near_classes(docs, id_col, text_col, **options).select(F.col(id_col).alias("n_id"), F.col("_th").alias("n_th"), "kept"), "classes")
    key = lambda i, h: F.xxhash64(F.coalesce(i.cast("string"), F.lit("")), h)
    keyed = classes.withColumn("k", key(F.col("n_id"), F.col("n_th")))
    lost, kept = keyed.where("not kept").drop("kept"), keyed.where("kept").drop("kept")
    again = lost.join(kept, lost["k"] == kept["k"], "left_semi").distinct()  # rows repeated with the kept one
    hashed = packed(docs, id=F.col(id_col), th=F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn("key", key(F.col("id"), F.col("th")))
    schema = StructType([*hashed.schema.fields, StructField("maybe", BooleanType())])
    flagged = hashed.mapInArrow(_flagging(hashed.columns, T.collect_bitmap(lost, "k", bits)), schema)
    on = F.col("id").eqNullSafe(F.col("n_id")) & (F.col("th") == F.col("n_th"))
    gone = lost.select("n_id", "n_th").distinct()
    stay = flagged.where("not maybe").unionByName(flagged.where("maybe").join(gone, on, "left_anti"))
    if again.isEmpty():
        return unpacked(stay)
    once = flagged.where("maybe").join(again.select("n_id", "n_th"), on, "left_semi").dropDuplicates(["id", "th"])
    return unpacked(stay.unionByName(once))
