"""Substring deduplication with repeated-phrase automata.

A window is ``length`` consecutive words. A word goes when a window over it also
starts in a document with a smaller id.

1. *Recurring passages.* The least k-gram hash of a window is its anchor;
   consecutive windows with one anchor form a segment. Equal windows have equal
   anchors, so a window can only recur where its anchor does. Segments are
   counted by (anchor, 128-bit content hash): a content that an earlier document
   has too is a confirmed passage as a whole. Where an anchor has several
   contents, single windows are compared as well, and those that an earlier
   document has are confirmed passages of ``length`` words. No position in a
   document leaves this step: a passage is its anchor phrase (the words), where
   it begins relative to the phrase, its length, its hash, and its first document.
2. *Automata.* Documents are dealt to shards, and each shard is sent the distinct
   confirmed passages that its documents can hold. It compiles their phrases into
   an Aho-Corasick automaton over word numbers and streams all its documents
   through it. Every hit of a phrase proposes the passages around it; a proposal
   counts if the words there hash to the passage, and then they are marked.

Shards are of documents and not of phrases, because with phrase shards every
document would have to visit every shard, which grows with the square of the
corpus.

Scale: about one segment in twenty words is shuffled (hashes only), then the
texts once, to shards of bounded size. Counts of a hot passage combine on the
map side. Nothing depends on pairs of documents.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import textkernels as T
from .scratch import ship, stored

ANCHOR = 10
#: Characters that stand for a word in an automaton, and bits of its number in each.
SYMBOLS, BITS = 3, 7
#: Proposals that are checked at once; bounds the memory of a check.
PROPOSALS = 1 << 17
SEGMENT = pa.struct([("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("o", pa.int32()), ("n", pa.int32())])
SEGMENT_DDL = "array<struct<h:bigint,a:bigint,b:bigint,o:int,n:int>>"
LAST = (1 << 63) - 1


class _Segments:
    """Segments of the rows of a slice: row, first word, number of windows, anchor hash and place."""

    def __init__(self, column: pa.Array, length: int):
        self.words, self.at = T.word_hashes(column, T.byte_class(T.SPACES))
        self.grams = grams = T.Grams(self.words)
        rows, starts = T.window_starts(self.at, length)
        anchors = grams.every(ANCHOR)
        least = T.sliding_min(anchors, length - ANCHOR + 1)[starts] if len(starts) else anchors[:0]
        new = np.ones(len(starts), bool)
        new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(new)
        self.n = np.diff(np.append(first, len(starts)))
        self.row, self.start, self.anchor = rows[first], starts[first], least[first]
        # Occurrences of the anchor hash: the last one that starts by the first window's end is in every window of the segment
        # unless equal phrases repeat; any occurrence inside the first window serves to find the segment again.
        span = np.arange(length - ANCHOR, -1, -1)
        self.place = self.start.copy()
        left = np.arange(len(first))
        for d in span:
            hit = anchors[self.start[left] + d] == self.anchor[left]
            self.place[left[hit]] = self.start[left[hit]] + d
            left = left[~hit]
            if not len(left):
                break
        total = self.n + length - 1
        self.a, self.b = grams.runs(self.start, total), grams.runs(self.start, total, 1)


def _winnow(length: int):
    """Segments of each text: anchor, content, the anchor's place in it, number of windows."""

    def kernel(batches):
        for whole in batches:
            for batch in T.slices(whole, "_text"):
                x = _Segments(batch.column("_text"), length)
                values = pa.StructArray.from_arrays([
                    pa.array(T.signed(x.anchor)), pa.array(T.signed(x.a)), pa.array(T.signed(x.b)),
                    pa.array((x.place - x.start).astype(np.int32)), pa.array(x.n.astype(np.int32)),
                ], fields=list(SEGMENT))
                size = T.column_bytes(batch.column("_text"))[0]
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id"), batch.column("_th"), pa.array(np.diff(size)),
                    T.list_array(np.bincount(x.row, minlength=batch.num_rows), values),
                ], ["_id", "_th", "bytes", "segments"])

    return kernel


def _numbers(words: np.ndarray) -> np.ndarray:
    """Word numbers as automata take them; words that share one are told apart by the passage's hash."""
    return words & T.U(0x7FFFFFFF)


def _phrases(length: int, wanted: T.Bitmap, several: T.Bitmap):
    """Of segments that may be the first of their content: the anchor phrase, and where ``several`` says so the single windows."""
    kinds = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("off", pa.int32())])

    def kernel(batches):
        for whole in batches:
            for batch in T.slices(whole, "_text"):
                x = _Segments(batch.column("_text"), length)
                key = x.a ^ np.asarray(batch.column("_id"))[x.row].astype(T.U)
                take = np.flatnonzero(wanted.holds(key))
                n = np.where(several.holds(key[take]), x.n[take], 0)
                at = np.repeat(x.start[take], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                values = pa.StructArray.from_arrays([
                    pa.array(T.signed(x.grams.runs(at, length))), pa.array(T.signed(x.grams.runs(at, length, 1))),
                    pa.array((at - np.repeat(x.place[take], n)).astype(np.int32)),
                ], fields=list(kinds))
                words = _numbers(x.words[x.place[take][:, None] + np.arange(ANCHOR)]).astype(np.int32)
                rows = pa.array(x.row[take])
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id").take(rows), batch.column("_th").take(rows),
                    pa.array(T.signed(x.anchor[take])), pa.array(T.signed(x.a[take])), pa.array(T.signed(x.b[take])),
                    T.list_array(np.full(len(take), ANCHOR), pa.array(words.ravel())), T.list_array(n, values),
                ], ["_id", "_th", "h", "a", "b", "phrase", "windows"])

    return kernel


def _symbols(numbers: np.ndarray) -> str:
    """Words as ``SYMBOLS`` characters each. A node of the automaton scans its children, so they have to be few;
    first characters have a range of their own, so that matches begin at words."""
    parts = np.stack([(numbers >> T.U(BITS * k)) & T.U((1 << BITS) - 1) for k in range(SYMBOLS)], axis=1).astype(np.uint16)
    parts[:, 0] += 1 << BITS
    return parts.astype("<u2").tobytes().decode("utf-16-le")


class _Passages:
    """The confirmed passages of a shard, found through an automaton of their phrases.

    ``table`` has the columns h (the phrase's hash), phrase (its word numbers, null
    where another row of the same h has them), off (where the passage begins,
    counted from the phrase; null in a row that only brings the phrase), t (its
    words), a and b (its hash), lo (the first document that has it). Rows may repeat.
    """

    def __init__(self, table: pa.Table):
        told = table.filter(pc.is_valid(table.column("phrase")))
        hashes, first = np.unique(told.column("h").to_numpy(), return_index=True)
        words = _symbols(told.column("phrase").combine_chunks().flatten().to_numpy().reshape(-1, ANCHOR)[first].ravel().astype(T.U))
        self.automaton, long = ahocorasick.Automaton(ahocorasick.STORE_INTS), ANCHOR * SYMBOLS
        for k in range(len(hashes)):
            self.automaton.add_word(words[k * long : (k + 1) * long], k)
        if words:
            self.automaton.make_automaton()
        table = table.filter(pc.is_valid(table.column("off")))
        h, off, t, a, b, lo = (table.column(c).to_numpy() for c in ("h", "off", "t", "a", "b", "lo"))
        order = np.lexsort((lo, b, a, t, off, h))
        h, off, t, a, b, lo = (x[order] for x in (h, off, t, a, b, lo))
        same_shape = (h[1:] == h[:-1]) & (off[1:] == off[:-1]) & (t[1:] == t[:-1])
        new, fresh = np.ones((2, len(h)), bool)
        new[1:], fresh[1:] = ~same_shape, ~(same_shape & (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
        # Shapes: where a passage lies around its phrase. A hit tries the shapes of its phrase, not the passages.
        shape = np.cumsum(new) - 1
        self.off, self.t = off[new].astype(np.int64), t[new].astype(np.int64)
        self.shape_at, self.shape_end = np.searchsorted(h[new], hashes, "left"), np.searchsorted(h[new], hashes, "right")
        key = self._key(shape[fresh], np.ascontiguousarray(a[fresh]).view(T.U))
        order = np.argsort(key, kind="stable")
        self.key, self.b, self.lo = key[order], np.ascontiguousarray(b[fresh]).view(T.U)[order], lo[fresh][order]

    @staticmethod
    def _key(shape: np.ndarray, a: np.ndarray) -> np.ndarray:
        return T.mix(a ^ T.mix(shape.astype(T.U)))

    def covered(self, words: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which words of the texts, whose rows start at ``at`` and have the ids ``ids``, a passage of an earlier document covers."""
        none = np.zeros(len(words), bool)
        if not len(self.key) or len(words) < ANCHOR:
            return none
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(_symbols(_numbers(words)))), np.int64).reshape(-1, 2)
        if not len(hits):
            return none
        grams = T.Grams(words)
        change = np.zeros(len(words) + 1, np.int64)
        total = np.cumsum(self.shape_end[hits[:, 1]] - self.shape_at[hits[:, 1]])
        for some in np.split(hits, np.searchsorted(total, np.arange(PROPOSALS, total[-1], PROPOSALS))):
            end, phrase = (some[:, 0] + 1) // SYMBOLS - 1, some[:, 1]
            tries = self.shape_end[phrase] - self.shape_at[phrase]
            shape = np.repeat(self.shape_at[phrase], tries) + np.arange(int(tries.sum())) - np.repeat(np.cumsum(tries) - tries, tries)
            place = np.repeat(end - ANCHOR + 1, tries)
            row = np.searchsorted(at, place, "right") - 1
            start = place + self.off[shape]
            stop = start + self.t[shape]
            inside = np.flatnonzero((start >= at[row]) & (stop <= at[row + 1]))
            shape, row, start, stop = shape[inside], row[inside], start[inside], stop[inside]
            key = self._key(shape, grams.runs(start, stop - start))
            found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            same = (self.key[found] == key) & (self.b[found] == grams.runs(start, stop - start, 1)) & (self.lo[found] < ids[row])
            np.add.at(change, start[same], 1)
            np.add.at(change, stop[same], -1)
        return np.cumsum(change[:-1]) > 0


def _removal(with_text: bool):
    """Per shard: compile the confirmed phrases, stream the shard's texts, leave out what confirmed passages cover."""
    inside = T.byte_class(T.SPACES)

    def kernel(texts: pa.Table, passages: pa.Table) -> pa.Table:
        known = _Passages(passages)
        n_words, n_removed, kept_hash, kept_text = [], [], [], []
        for whole in texts.to_batches():
            for batch in T.slices(whole, "_text"):
                words, at = T.word_hashes(batch.column("_text"), inside)
                gone = known.covered(words, at, np.asarray(batch.column("_id")))
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[at])
                for k, text in enumerate(batch.column("_text").to_pylist()):
                    own = (text or "").encode().split()
                    if removed[k]:
                        own = [own[j] for j in np.flatnonzero(~gone[at[k] : at[k + 1]]).tolist()]
                    kept = b" ".join(own)
                    kept_hash.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_text.append(kept.decode())
                n_words += np.diff(at).tolist()
                n_removed += removed.tolist()
        columns = {"_row": texts.column("_row"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(kept_hash, pa.string())}
        if with_text:
            columns["kept_text"] = pa.array(kept_text, pa.string())
        return pa.table(columns)

    return kernel


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
             shard_bytes: int = 8 << 20, bits: int | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (and kept_text if asked for).

    Null and empty texts have no words; texts of fewer than ``length`` words keep
    all. Rows with equal ids, repeated rows too, never take words from each
    other. A null id counts as larger than any other. Texts and words may be of
    any length. An empty table gives an empty result; other columns are not read.
    ``bits`` fixes the size of the bit arrays, which changes the cost and not the
    result.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64(text).alias("_th"),
        text.alias("_text"), F.col(id_col).alias("_row"))
    slim = base.select("_id", "_th", "_text")
    found = stored(slim.mapInArrow(_winnow(length), f"_id bigint, _th bigint, bytes bigint, segments {SEGMENT_DDL}"), "segments")
    total = found.agg(F.sum("bytes")).first()[0] or 0
    shard = F.pmod(F.xxhash64("_id", "_th"), F.lit(total // shard_bytes + 1)).alias("_shard")
    segments = found.select("_id", shard, F.inline("segments"))

    content = ["h", "a", "b"]
    contents = segments.groupBy(*content).agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.any_value("o").alias("o"), F.any_value("n").alias("n"))
    # Stored, so that a hot anchor can be split in the join.
    anchors = stored(contents.groupBy("h").agg(F.min("lo").alias("x"), F.max("hi").alias("y"), F.count(F.lit(1)).alias("c")).where("x < y").select("h", "c"), "anchors")
    recurring = stored(contents.join(anchors, "h").where("hi > lo or c > 1").select(*content, "lo", "c", "o", "n"), "recurring")
    first = recurring.select(F.col("a").bitwiseXOR(F.col("lo")).alias("k"), "c")
    wanted, several = T.collect_bitmap(first, "k", bits), T.collect_bitmap(first.where("c > 1"), "k", bits)
    # A row for each content and shard of its first document (rows may share an id): its phrase, and its windows where other
    # contents share the anchor. One row of each content is the main one.
    one = F.min("_shard").over(Window.partitionBy(*content)) == F.col("_shard")
    firsts = stored(
        slim.mapInArrow(
            _phrases(length, wanted, several),
            "_id bigint, _th bigint, h bigint, a bigint, b bigint, phrase array<int>, windows array<struct<a:bigint,b:bigint,off:int>>",
        ).join(recurring, content).where("_id = lo").withColumn("_shard", shard).dropDuplicates([*content, "_shard"])
        .select("_id", "_shard", *content, "lo", "c", "o", "n", "phrase", "windows", one.alias("main")), "firsts")
    windows = firsts.where("c > 1").select("_id", "_shard", "h", F.inline("windows"))
    # Only windows of several documents; stored, so that a hot window can be split in the join.
    earliest = stored(windows.groupBy("a", "b").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").drop("hi"), "earliest")
    single = windows.join(earliest, ["a", "b"]).where("lo < _id").select("_shard", "h", "off", F.lit(length).alias("t"), "a", "b", "lo")
    whole = segments.select("_id", "_shard", *content).join(firsts.where("main").select(*content, "lo", "o", "n", "phrase"), content).where("_id > lo").select(
        "_shard", "h", (-F.col("o")).alias("off"), (F.col("n") + (length - 1)).alias("t"), "a", "b", "lo", "phrase")
    # Single windows go without their phrase, which goes once for each document that has some.
    passages = whole.unionByName(single, allowMissingColumns=True).unionByName(
        firsts.where("c > 1").select("_shard", "h", "phrase"), allowMissingColumns=True)
    out = f"_row {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    done = base.select("*", shard).groupBy("_shard").cogroup(passages.groupBy("_shard")).applyInArrow(_removal(with_text), out)
    return done.withColumnRenamed("_row", id_col)
