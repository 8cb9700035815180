"""Benchmark decontamination by winnowing.

A window is ``length`` consecutive words of an item, or all words of a shorter
item. In each window the least k-gram hash, leftmost of equals, is selected;
selected k-grams with their places are the fingerprints of a text. Equal windows
select the same k-gram at the same place in them, so every shared window has a
shared fingerprint.

Fingerprints of documents and items are joined on their hash. Each carries the
words on both sides of its k-gram, as far as a window can reach; a joined pair
is extended over the words that agree on the left and on the right, and counts
if the extended run holds a window. The words of that run are hit.

Before the join, a document keeps those windows only whose fingerprint, and then
whose own hash, may be among the items' (two bit arrays, sized by the items), so
that common phrases which no item window holds are not joined.

Scale: texts are read once and not shuffled; only ids, counts and the fingerprints
of hits are. Both sides of the join come to it straight from an exchange, so a hot
fingerprint can be split in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernels as T
from .scratch import packed, ship, stored, unpacked

#: ASCII but digits and letters; everything else, beyond ASCII too, is in a word.
DELIMITERS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: In place of a word beyond the end of a text, by side, so that ends never agree.
NO_WORD = {"document": 0, "item": 1}


def _sides(length: int, k: int) -> list[str]:
    """Names of the words to the left (nearest first) and to the right of a fingerprint's k-gram."""
    return [f"{side}{j}" for side in "lr" for j in range(length - min(k, length))]


class _Text:
    """Words, row bounds and k-grams of a slice of texts."""

    def __init__(self, column: pa.Array):
        self.words, self.at = T.word_hashes(column, T.byte_class(DELIMITERS), lower=True)
        self.grams, self.counts = T.Grams(self.words), np.diff(self.at)
        self.kgrams: dict[int, np.ndarray] = {}

    def every(self, k: int) -> np.ndarray:
        if k not in self.kgrams:
            self.kgrams[k] = self.grams.every(k)
        return self.kgrams[k]

    def least(self, starts: np.ndarray, m: int, k: int) -> np.ndarray:
        """The least k-gram hash of each window of ``m`` words."""
        return T.sliding_min(self.every(k), m - k + 1)[starts] if len(starts) else np.zeros(0, T.U)

    def selected(self, starts: np.ndarray, least: np.ndarray, m: int, k: int) -> np.ndarray:
        """Where in the slice the least k-gram of each window is, leftmost of equals."""
        every = self.every(k)
        place, left = starts.copy(), np.arange(len(starts))
        for d in range(m - k + 1):
            hit = every[starts[left] + d] == least[left]
            place[left[hit]] += d
            left = left[~hit]
        return place

    def around(self, rows: np.ndarray, place: np.ndarray, reach: int, k: int, none: int) -> list[pa.Array]:
        """The ``reach`` words before and after each k-gram, as columns."""
        columns = []
        for offset in [-1 - j for j in range(reach)] + [k + j for j in range(reach)]:
            at = place + offset
            inside = (at >= self.at[rows]) & (at < self.at[rows + 1])
            columns.append(pa.array(T.signed(np.where(inside, self.words[np.where(inside, at, 0)], T.U(none)))))
        return columns


def _item_prints(length: int, k: int):
    """Fingerprints of items, each with the hashes of the windows that select it."""

    def kernel(batches):
        for whole in batches:
            for batch in T.slices(whole, "_text"):
                x = _Text(batch.column("_text"))
                for m in sorted({min(int(n), length) for n in x.counts if n}):
                    own = x.counts >= length if m == length else x.counts == m
                    rows, starts = T.window_starts(x.at, m)
                    rows, starts = rows[own[rows]], starts[own[rows]]
                    size = min(k, m)
                    least = x.least(starts, m, size)
                    place = x.selected(starts, least, m, size)
                    new = np.ones(len(place), bool)
                    new[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
                    first = np.flatnonzero(new)
                    per = np.diff(np.append(first, len(place)))
                    windows = T.list_array(per, pa.array(T.signed(x.grams.runs(starts, m))))
                    rows, place, least = rows[first], place[first], least[first]
                    yield pa.RecordBatch.from_arrays([
                        batch.column("item_id").take(pa.array(rows)), pa.array(np.full(len(rows), m, np.int32)), pa.array(T.signed(least)),
                        *x.around(rows, place, length - min(k, length), size, NO_WORD["item"]), windows,
                    ], ["item_id", "m", "fp", *_sides(length, k), "windows"])

    return kernel


def _document_prints(length: int, k: int, sizes: list[int], prints: T.Bitmap, windows: T.Bitmap):
    """Per document its number of words and the fingerprints that may be of item windows."""
    names = ["m", "p", "fp", *_sides(length, k)]
    kinds = [pa.int32(), pa.int32()] + [pa.int64()] * (len(names) - 2)

    def kernel(batches):
        for whole in batches:
            for batch in T.slices(whole, "_text"):
                x = _Text(batch.column("_text"))
                found = []
                for m in sizes:
                    size = min(k, m)
                    rows, starts = T.window_starts(x.at, m)
                    least = x.least(starts, m, size)
                    near = np.flatnonzero(prints.holds(least))
                    near = near[windows.holds(x.grams.runs(starts[near], m))]
                    rows, starts, least = rows[near], starts[near], least[near]
                    place = x.selected(starts, least, m, size)
                    new = np.ones(len(place), bool)
                    new[1:] = place[1:] != place[:-1]
                    rows, place, least = rows[new], place[new], least[new]
                    found.append((rows, [
                        pa.array(np.full(len(rows), m, np.int32)), pa.array((place - x.at[rows]).astype(np.int32)), pa.array(T.signed(least)),
                        *x.around(rows, place, length - min(k, length), size, NO_WORD["document"]),
                    ]))
                rows = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
                order = pa.array(np.argsort(rows, kind="stable"))
                columns = [pa.concat_arrays([c[j] for _, c in found]).take(order) if found else pa.array([], kind) for j, kind in enumerate(kinds)]
                per_row = np.bincount(rows, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(x.counts), T.list_array(per_row, pa.StructArray.from_arrays(columns, names))],
                    ["_id", "n_words", "prints"])

    return kernel


def _agreeing(side: str, reach: int):
    """How many words next to a k-gram agree in both texts, up to ``reach`` and to what a window of ``m`` words can hold."""
    count = F.lit(reach)
    for j in reversed(range(reach)):
        count = F.when((F.col("m") - F.col("k") <= j) | (F.col(f"{side}{j}") != F.col(f"i_{side}{j}")), F.lit(j)).otherwise(count)
    return count


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", length: int = 10, k: int = 5, bits: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words. Items without words are ignored; items with a null
    id mark words but are not counted. Repeated rows each get their result, and
    repeated items count once. Texts may be of any length. Either table may be
    empty; other columns are not read, so their names cannot clash. ``bits`` fixes
    the size of the bit arrays, which changes the cost and not the result.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    sides, reach = _sides(length, k), length - min(k, length)
    words = ", ".join(f"{s} bigint" for s in sides)
    known = stored(
        items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("_text")).mapInArrow(
            _item_prints(length, k), f"item_id {item_kind}, m int, fp bigint, {words}, windows array<bigint>"
        ).distinct(), "items")
    sizes = sorted(r.m for r in known.select("m").distinct().collect())  # ``length`` rows at most
    kernel = _document_prints(
        length, k, sizes, T.collect_bitmap(known, "fp", bits), T.collect_bitmap(known.select(F.explode("windows").alias("w")), "w", bits))
    struct = f"m:int,p:int,fp:bigint,{','.join(f'{s}:bigint' for s in sides)}"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        kernel, f"_id {kind}, n_words bigint, prints array<struct<{struct}>>").withColumn("_row", F.monotonically_increasing_id())
    # Documents without fingerprints go along with a key of their own that no item has, so that they do not meet in one task.
    ours = rows.select("_row", "_id", "n_words", F.expr("inline_outer(prints)")).withColumns(
        {"m": F.coalesce("m", F.lit(0)), "fp": F.coalesce("fp", F.xxhash64("_row"))})
    theirs = known.select("item_id", "m", "fp", F.lit(True).alias("met"), *[F.col(s).alias(f"i_{s}") for s in sides])
    met = ours.join(theirs, ["m", "fp"], "left").withColumn("k", F.least("m", F.lit(k)))
    runs = met.withColumns({"left": _agreeing("l", reach), "right": _agreeing("r", reach)})
    held = F.col("met") & (F.col("left") + F.col("k") + F.col("right") >= F.col("m"))
    span = F.struct((F.col("p") - F.col("left")).alias("s"), (F.col("p") + F.col("k") + F.col("right")).alias("e"))
    # Ends of the words covered so far, then the words that each next run adds.
    covered = F.expr("""aggregate(spans, named_struct('n', 0, 'e', 0),
        (a, x) -> named_struct('n', a.n + greatest(0, x.e - greatest(a.e, x.s)), 'e', greatest(a.e, x.e))).n""")
    return runs.groupBy("_row").agg(
        F.any_value("_id").alias(id_col), F.any_value("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(held, span))).alias("spans"),
        F.sort_array(F.collect_set(F.when(held, F.col("item_id").cast("string")))).alias("ids"),
    ).select(
        id_col, "n_words", covered.cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any window of an item, with all their columns.

    Rows are told apart by id and text, so equal rows share their verdict. Columns
    of any name pass through: a row is carried in one struct beside the key.
    """
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))
    bad = contamination(docs.select(key.alias("key"), F.col(text_col).alias("body")), items, "key", "body", **options)
    bad = bad.where("contaminated").select(F.col("key").alias("bad")).distinct()
    return unpacked(packed(docs, key=key).join(bad, F.col("key").eqNullSafe(F.col("bad")), "left_anti"))
