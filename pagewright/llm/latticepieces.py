"""SentencePiece segmentations sampled from the piece lattice, and their decoding.

The vocabulary comes from a public model file whose scores are merge ranks, so
piece weights follow Zipf's law in the rank, normalised to probabilities. A text
is a product of units (a run of spaces and the word after it) that no piece
crosses. Per distinct unit, its lattice is found by hashes of its substrings, and forward filtering sums the weight of all
segmentations up to each position; per occurrence, backward sampling draws the
last piece, then the one before it, and so on, each with its exact conditional
probability. Random numbers are hashes of the row key, the unit's place and the
step, so a row is segmented alike wherever and whenever it runs. Characters
without a piece become byte pieces, which keeps decoding lossless; so does a
literal U+2581, which only has byte pieces here.

Memory is bounded by blocks of units, the cache of unit lattices by ``CACHED``.
A unit of more than ``LONG`` characters (a text without spaces) is filtered and
sampled in stretches: of its lattice only one number a character is kept, and
its edges are found again, a stretch at a time, on the way back.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from . import textkernels as T
from .scratch import packed, ship, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BLOCK, CACHED = 100_000, 100_000
SLOTS = 18  # log2 of the slots that the hashes of pieces fall into
LEARN = 8_192  # new units whose lattices are made at once
LONG, STRETCH = 20_000, 4_096
STEP, PLACE = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def vocabulary(path: str = MODEL) -> tuple[list[tuple[int, str, float]], list[int], int]:
    """([(id, piece with plain spaces, rank)], ids of the byte pieces, size) of a model file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, by_byte = [], [0] * 256
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            by_byte[int(text[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((i, text.replace(SPACE, " "), -model.get_score(i)))
    crossing = [p for _, p, _ in pieces if "\n" in p or " " in p.lstrip(" ") or p.startswith("  ") and p.strip(" ")]
    if crossing:
        raise ValueError(f"pieces that cross units: {crossing[:3]}")
    return pieces, by_byte, model.get_piece_size()


def unit_pattern(pieces: list[str]) -> re.Pattern:
    """Units that no piece crosses: spaces and a word, or spaces and a run from a mark on.

    A mark is ASCII punctuation that pieces only have after other marks or a
    space, so no piece reaches from a word into it.
    """
    before: dict[str, set[str]] = {}
    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            before.setdefault(b, set()).add(a)
    marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}
    while bad := {c for c in marks if before.get(c, set()) - marks - {" "}}:
        marks -= bad
    if not marks:
        return re.compile(r" *+[^ \n]++| *+\n| ++")
    some = re.escape("".join(sorted(marks)))
    return re.compile(rf" *+[^ \n{some}]++| *+[{some}][^ \n]*+| *+\n| ++")


class _Unseen(dict):
    """Numbers units in the order of their first look-up."""

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        return number


class _Growing:
    """An array that grows in place, at the cost of some spare room."""

    def __init__(self, kind):
        self._held, self._n = np.empty(1 << 16, kind), 0

    def append(self, more: np.ndarray) -> None:
        need = self._n + len(more)
        if need > len(self._held):
            held = np.empty(max(need, len(self._held) * 3 // 2), self._held.dtype)
            held[: self._n] = self.all
            self._held = held
        self._held[self._n : need] = more
        self._n = need

    @property
    def all(self) -> np.ndarray:
        return self._held[: self._n]


class Sampler:
    """Encodes texts by sampling; holds the lattices of the units seen so far."""

    def __init__(self, pieces, by_byte, size):
        self.size, self.by_byte = size, np.array(by_byte, np.int64)
        rank = np.array([r for _, _, r in pieces])
        weight = -np.log(rank - rank.min() + 2.7)
        norm = np.log(np.exp(weight).sum())
        self.log = np.full(size, -np.inf)
        self.length = np.zeros(size, np.int64)
        self.bytes = byte_table(pieces, by_byte, size)
        self.single = single = np.full(0x110000, -1, np.int32)  # pieces of one character, by code point
        self.unit = unit_pattern([text for _, text, _ in pieces])
        longer: dict[int, list[tuple[int, str]]] = {}
        for (i, text, _), w in zip(pieces, weight):
            self.log[i], self.length[i] = w - norm, len(text)
            if len(text) == 1:
                single[ord(text)] = i
            else:
                longer.setdefault(len(text), []).append((i, text))
        #: Of each length, the hashes of its pieces in order, their ids, and a table of slots that some piece has.
        self.by_length = []
        for size, own in sorted(longer.items()):
            points = np.array([list(map(ord, text)) for _, text in own], np.uint32)
            hashes = ((points.astype(T.U) + T.U(1)) * T.powers(T.WORD_BASES[0], size)[0][:size]).sum(axis=1, dtype=T.U)
            order = np.argsort(hashes)
            slots = np.zeros(1 << SLOTS, bool)
            slots[self._slot(hashes)] = True
            self.by_length.append((size, hashes[order], np.array([i for i, _ in own])[order], slots))
        self.byte_log = float(weight.min() - norm) - 2.0
        self.reset()

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * T.U(STEP)) >> T.U(64 - SLOTS)

    def _matches(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first character, id) of every piece of two characters or more in a run of code points, by hashes of its substrings."""
        n = len(points)
        up, down = T.powers(T.WORD_BASES[0], n + 1)
        total = np.zeros(n + 1, T.U)
        np.cumsum((points.astype(T.U) + T.U(1)) * up[:n], out=total[1:])
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, hashes, ids, slots in self.by_length:
            if size > n:
                break
            here = (total[size:] - total[:-size]) * down[: n - size + 1]
            maybe = np.flatnonzero(slots[self._slot(here)])
            place = np.minimum(np.searchsorted(hashes, here[maybe]), len(hashes) - 1)
            sure = hashes[place] == here[maybe]
            starts.append(maybe[sure])
            found.append(ids[place[sure]])
        return np.concatenate(starts), np.concatenate(found)

    def reset(self) -> None:
        self.units = _Unseen()
        self.last = _Growing(np.int32)  # node at the end of each unit
        self.keys, self.ids, self.back = _Growing(np.float64), _Growing(np.int32), _Growing(np.int32)
        self.nodes = 0

    def _learn(self, fresh: list[str]) -> None:
        """Forward filtering over the lattices of new units, all at once by position."""
        joined = "\n".join(fresh)
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        begin = np.cumsum(sizes + 1) - sizes - 1
        # A unit may hold "\n" itself, always as its last character; no piece has one, so matches never cross units.
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first, piece = self._matches(points)
        owner = np.repeat(np.arange(len(fresh), dtype=np.int32), sizes + 1)[: len(joined)]
        inside = np.flatnonzero(np.arange(len(joined)) < (begin + sizes)[owner])
        char = self.single[points[inside]]
        odd = char < 0
        width = 1 + (points[inside] > 0x7F) + (points[inside] > 0x7FF) + (points[inside] > 0xFFFF)
        start = np.concatenate([first, inside])
        end = np.concatenate([first + self.length[piece], inside + 1])
        ids = np.concatenate([piece, np.where(odd, self.size + points[inside].astype(np.int64), char)])
        log = np.concatenate([self.log[piece], np.where(odd, width * self.byte_log, self.log[char])])
        first_of = begin[owner[end - 1]]
        level = end - first_of
        order = np.argsort(end, kind="stable")
        if level.max() < 1 << 15:
            order = order[np.argsort(level[order].astype(np.int16), kind="stable")]
        else:
            order = order[np.argsort(level[order], kind="stable")]
        start, end, log, ids, level, first_of = (x[order] for x in (start, end, log, ids, level, first_of))
        new = np.ones(len(end), bool)
        new[1:] = end[1:] != end[:-1]
        node = np.cumsum(new) - 1
        group = np.flatnonzero(new)
        reached = np.full(len(joined) + 2, -np.inf)
        reached[begin] = 0.0
        cuts = np.searchsorted(level, np.arange(1, int(level[-1]) + 2))
        share = np.empty(len(end))
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            value = reached[start[low:high]] + log[low:high]
            first = group[np.searchsorted(group, low) : np.searchsorted(group, high)]
            total = np.logaddexp.reduceat(value, first - low)
            reached[end[first]] = total
            share[low:high] = np.exp(value - total[node[low:high] - node[low]])
        run = np.cumsum(share)
        base = np.concatenate([[0.0], run])[group]
        run -= base[node]
        final = np.append(group[1:], len(end)) - 1
        run = np.minimum(run / run[final][node], 1.0)
        run[final] = 1.0
        at = np.full(len(joined) + 2, -1, np.int64)
        at[end[group]] = np.arange(len(group)) + self.nodes
        back = at[start]
        back[start == first_of] = -1
        self.keys.append(node + self.nodes + run)
        self.ids.append(ids)
        self.back.append(back)
        self.last.append(at[begin + sizes])
        self.nodes += len(group)

    def _stretch(self, unit: str, low: int) -> list[list[tuple[int, int, float]]]:
        """The edges (start, id, log weight) that end at each of the places low + 1, ..., low + ``STRETCH``."""
        high, first = min(low + STRETCH, len(unit)), max(0, low - int(self.length.max()) + 1)
        edges: list[list[tuple[int, int, float]]] = []
        for at in range(low, high):
            point = ord(unit[at])
            i = int(self.single[point])
            width = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
            edges.append([(at, i, float(self.log[i])) if i >= 0 else (at, self.size + point, width * self.byte_log)])
        starts, found = self._matches(np.frombuffer(unit[first:high].encode("utf-32-le"), np.uint32))
        for start, i in zip((starts + first).tolist(), found.tolist()):
            end = start + int(self.length[i])
            if end > low:
                edges[end - 1 - low].append((start, i, float(self.log[i])))
        return edges

    def sample_long(self, unit: str, seed: int) -> np.ndarray:
        """Piece ids of one unit of any length, in memory of a few bytes a character."""
        reached = array("d", [0.0])
        for low in range(0, len(unit), STRETCH):
            for edges in self._stretch(unit, low):
                values = [reached[s] + w for s, _, w in edges]
                most = max(values)
                reached.append(most + math.log(sum(math.exp(v - most) for v in values)))
        drawn, place, held, low, state = array("q"), len(unit), [], -1, seed
        while place:
            if (place - 1) // STRETCH * STRETCH != low:
                low = (place - 1) // STRETCH * STRETCH
                held = self._stretch(unit, low)
            edges = held[place - 1 - low]
            shares = [math.exp(reached[s] + w - reached[place]) for s, _, w in edges]
            state = (state * STEP + PLACE) & 0xFFFFFFFFFFFFFFFF
            left = (state >> 11) * 2.0**-53 * sum(shares)
            for (start, i, _), share in zip(edges, shares):
                left -= share
                if left < 0:
                    break
            drawn.extend([i] if i < self.size else [int(self.by_byte[b]) for b in reversed(chr(i - self.size).encode())])
            place = start
        return np.array(drawn, np.int64)[::-1]

    def sample(self, units: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, number of pieces of each unit) for units with a random seed each."""
        if max(map(len, units), default=0) <= LONG:
            return self._sample(units, seeds)
        long = {k: self.sample_long(unit, int(seeds[k])) for k, unit in enumerate(units) if len(unit) > LONG}
        ids, counts = self._sample([unit if k not in long else " " for k, unit in enumerate(units)], seeds)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k, own in long.items():
            parts[k], counts[k] = own, len(own)
        return np.concatenate(parts), counts

    def _sample(self, units: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.units) > CACHED:
            self.reset()
        known = len(self.units)
        code = np.fromiter(map(self.units.__getitem__, units), np.int32, len(units))
        if len(self.units) > known:
            fresh = list(islice(self.units, known, None))
            for k in range(0, len(fresh), LEARN):
                self._learn(fresh[k : k + LEARN])
        who = np.argsort(code)
        keys, piece, before = self.keys.all, self.ids.all, self.back.all
        node, counts, drawn = self.last.all[code[who]], np.zeros(len(units), np.int64), []
        state = seeds[who]
        while len(who):
            state = state * T.U(STEP) + T.U(PLACE)  # a linear congruential step; its high bits are the random number
            edge = np.searchsorted(keys, node + (state >> T.U(11)).astype(float) * 2.0**-53, "right")
            # Rounding of node + u may reach the next node; the last edge is then meant.
            edge -= keys[np.minimum(edge, len(keys) - 1)] > node + 1
            drawn.append((who, piece[edge]))
            counts[who] += 1
            node = before[edge]
            on = np.flatnonzero(node >= 0)
            who, node, state = who[on], node[on], state[on]
        place = np.cumsum(counts)
        ids = np.empty(int(counts.sum()), np.int64)
        for k, (who, got) in enumerate(drawn):
            ids[place[who] - 1 - k] = got
        virtual = np.flatnonzero(ids >= self.size)
        if len(virtual):
            width = np.ones(len(ids), np.int64)
            raw = [chr(int(i) - self.size).encode() for i in ids[virtual]]
            width[virtual] = [len(b) for b in raw]
            owner = np.repeat(np.arange(len(units)), counts)
            counts = np.bincount(owner, width, len(units)).astype(np.int64)
            first = np.cumsum(width) - width
            ids = np.repeat(ids, width)
            for at, b in zip(first[virtual].tolist(), raw):
                ids[at : at + len(b)] = self.by_byte[list(b)]
        return ids, counts

    def encode(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text; ``seeds`` (uint64) fixes each text's draw."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        units: list[str] = []
        owners: list[tuple[int, int, int]] = []  # text, first place, number of units

        def flush() -> None:
            if not units:
                return
            text = np.repeat([o[0] for o in owners], [o[2] for o in owners])
            place = np.concatenate([np.arange(o[1], o[1] + o[2]) for o in owners]).astype(T.U)
            ids, counts = self.sample(units, T.mix(seeds[text] + place * T.U(PLACE)))
            at = np.concatenate([[0], np.cumsum(counts)])
            here = 0
            for row, _, n in owners:
                parts[row].append(ids[at[here] : at[here + n]])
                here += n
            units.clear()
            owners.clear()

        for row, text in enumerate(texts):
            if not text:
                continue
            if len(text) < BLOCK:  # at most so many units
                matches = iter(self.unit.findall(" " + text))
            else:
                matches = (m[0] for m in self.unit.finditer(" " + text))
            place = 0
            while block := list(islice(matches, BLOCK)):
                units += block
                owners.append((row, place, len(block)))
                place += len(block)
                if len(units) >= BLOCK:
                    flush()
        flush()
        return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]

    def decode(self, ids: list[int]) -> str:
        """The text of a piece sequence."""
        return decode(self.bytes, ids)


def decode(table: list[bytes], ids: list[int]) -> str:
    return b"".join(map(table.__getitem__, ids))[1:].decode("utf-8", "replace")


def byte_table(pieces, by_byte, size) -> list[bytes]:
    """The bytes of each piece id; control pieces have none."""
    table = [b""] * size
    for i, text, _ in pieces:
        table[i] = text.encode()
    for b, i in enumerate(by_byte):
        table[i] = bytes([b])
    return table


def _sampler(shared) -> Sampler:
    key = shared.id if hasattr(shared, "id") else id(shared)
    if _HELD.get("key") != key:
        _HELD.update(key=key, sampler=Sampler(*shared.value))
    return _HELD["sampler"]


_HELD: dict = {}


def _encoding(shared, place: int, check: bool):
    def kernel(batches):
        sampler = _sampler(shared)
        for whole in batches:
            text = pc.struct_field(whole.column("row"), [place]).cast(pa.string())
            for batch in T.slices(pa.RecordBatch.from_arrays([*whole.columns, text], ["row", "seed", "text"]), "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = sampler.encode(texts, np.asarray(batch.column("seed")).astype(np.int64).view(T.U))
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                column = T.list_array(np.array([len(i) for i in ids]), pa.array(flat.astype(np.int32)))
                back = pa.array([sampler.decode(i.tolist()) == t if check else None for i, t in zip(ids, texts)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("row"), column, back], ["row", "ids", "lossless"])

    return kernel


def _seed(id_col: str, seed: int):
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "piece_ids", seed: int = 0, model: str = MODEL,
            lossless: str | None = None) -> DataFrame:
    """``docs`` with an array column ``out`` of sampled piece ids.

    With ``lossless``, a boolean column of that name tells whether decoding the
    pieces gives the text back.

    A row's draw depends on ``seed``, its id and its text only: repeated rows are
    segmented alike, null ids share a seed. Null and empty texts have no pieces.
    Columns of ``docs`` with the names of the new ones are replaced; others of any
    name pass through.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(model))  # a vocabulary: bounded whatever the corpus
    rows = packed(docs, seed=_seed(id_col, seed))
    schema = StructType([rows.schema["row"], StructField("ids", ArrayType(IntegerType())), StructField("lossless", BooleanType())])
    made = rows.mapInArrow(_encoding(shared, docs.columns.index(text_col), lossless is not None), schema)
    return unpacked(made, **{out: F.col("ids")}, **({lossless: F.col("lossless")} if lossless else {}))


def decoded(rows: DataFrame, ids_col: str = "piece_ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with a string column ``out``: the text of the pieces in ``ids_col``; empty for a null or empty list.

    A column that is called ``out`` too is replaced; others of any name pass through.
    """
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(model))
    place = rows.columns.index(ids_col)

    def kernel(batches):
        table = byte_table(*shared.value)
        for batch in batches:
            texts = [decode(table, ids or []) for ids in pc.struct_field(batch.column("row"), [place]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    every = packed(rows)
    made = every.mapInArrow(kernel, StructType([*every.schema.fields, StructField("text", StringType())]))
    return unpacked(made, **{out: F.col("text")})


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, model: str = MODEL) -> DataFrame:
    """One row per row of ``docs``: id, n_pieces, pieces_sha256, decoded_sha256, lossless.

    Encodes and decodes each whole text on the executors. pieces_sha256 is of the
    ids as 32-bit little-endian integers, decoded_sha256 of the decoded text. Null
    and empty texts have no pieces and decode to the empty text, without loss;
    repeated rows and null ids pass through; an empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(model))
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches):
        sampler = _sampler(shared)
        for whole in batches:
            for batch in T.slices(whole, "_text"):
                texts = batch.column("_text").to_pylist()
                ids = sampler.encode(texts, np.asarray(batch.column("_seed")).view(T.U))
                back = [sampler.decode(i.tolist()) for i in ids]
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id"), pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                    pa.array([a == b for a, b in zip(texts, back)]),
                ], ["_id", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"])

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), _seed(id_col, seed).alias("_seed"))
    schema = f"_id {kind}, n_pieces bigint, pieces_sha256 string, decoded_sha256 string, lossless boolean"
    return rows.mapInArrow(kernel, schema).withColumnRenamed("_id", id_col)
