"""Vectorised word and n-gram hashing over Arrow string columns.

Words are runs of bytes outside a delimiter set; all delimiters are ASCII, so
UTF-8 text is scanned as bytes. Every hash is a polynomial over the integers
mod 2^64, taken from prefix sums, then mixed; costs are linear in the text and
memory is bounded by the chunk, plus eight bytes a word of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 18
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_class(delimiters: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    table = np.ones(256, bool)
    table[list(delimiters)] = False
    return table


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, CHUNK + 1)
        both = []
        for value in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, value, U)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(batch: pa.RecordBatch, name: str, most: int = CHUNK, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in runs of at most ``most`` bytes of text and ``rows`` rows, or one row."""
    if not batch.num_rows:
        return
    at, _ = column_bytes(batch.column(name))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        end = min(end, start + rows)
        yield batch.slice(start, end - start)
        start = end


def _hash_span(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words in ``data``, cut at ``at`` too."""
    word = inside[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[at[at < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    inner = at[(at > 0) & (at <= len(data))]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    up, down = powers(BYTE_BASE, len(data) + 1)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F))
    for k in np.flatnonzero(ends - starts >= CHUNK).tolist():
        h[k] = _long_hash(data[starts[k] : ends[k]])
    return h, starts, ends


def _long_hash(word: np.ndarray) -> np.uint64:
    """Hash of a word of ``CHUNK`` bytes or more, the same in a text of any length."""
    return np.frombuffer(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), U)[0]


def word_hashes(column: pa.Array, inside: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words up to each row's start and the end)."""
    at, raw = column_bytes(column)
    base, stop = int(at[0]), int(at[-1])
    if stop == base:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    data = raw[base:stop]
    at = at - base
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        data = fold[data]
    if len(data) <= 2 * CHUNK:
        h, starts, _ = _hash_span(data, at, inside)
        return h, np.searchsorted(starts, at)
    # One long text (see slices): hash it in pieces that end at a delimiter.
    assert len(at) == 2, "long columns are sliced first"
    parts, here = [], 0
    while here < len(data):
        end = min(here + CHUNK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~inside[data[here:end]])
            if len(gaps):
                end = here + int(gaps[-1]) + 1
            else:  # a word longer than a chunk
                while end < len(data) and inside[data[end]]:
                    tail = np.flatnonzero(~inside[data[end : end + CHUNK]])
                    end = end + int(tail[0]) if len(tail) else min(end + CHUNK, len(data))
                parts.append(np.array([_long_hash(data[here:end])], U))
                here = end
                continue
        parts.append(_hash_span(data[here:end], np.array([0, end - here]), inside)[0])
        here = end
    h = np.concatenate(parts)
    return h, np.array([0, len(h)])


class Grams:
    """Hashes of any run of words, from prefix sums over the words of a slice."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.sums = []
        for k, base in enumerate(WORD_BASES):
            up, _ = powers(base, self.n + 1)
            total = np.empty(self.n + 1, U)
            total[0] = 0
            np.cumsum((words if k == 0 else mix(words + U(0x632BE59BD9B4E019))) * up[: self.n], out=total[1:])
            self.sums.append(total)

    def runs(self, starts: np.ndarray, lengths, which: int = 0) -> np.ndarray:
        total, (_, down) = self.sums[which], powers(WORD_BASES[which], self.n + 1)
        h = (total[starts + lengths] - total[starts]) * down[starts]
        return mix(h + np.asarray(lengths).astype(U) * U(0x9FB21C651E98DF25))

    def every(self, k: int, which: int = 0) -> np.ndarray:
        """The k-gram at each word, across rows too; callers select starts that stay in a row."""
        if self.n < k:
            return np.zeros(0, U)
        total, (_, down) = self.sums[which], powers(WORD_BASES[which], self.n + 1)
        return mix((total[k:] - total[:-k]) * down[: self.n - k + 1] + U(k * 0x9FB21C651E98DF25 % (1 << 64)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def window_starts(counts_at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word) of every run of ``length`` words within a row."""
    fits = np.maximum(np.diff(counts_at) - length + 1, 0)
    rows = np.repeat(np.arange(len(fits)), fits)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(fits) - fits, fits)
    return rows, counts_at[rows] + within


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_array(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


class Bitmap:
    """A set of 64-bit hashes as a bit array; it may say yes too often, never no wrongly."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, h: np.ndarray) -> np.ndarray:
        slot = h & U((1 << self.bits) - 1)
        return (self.words[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1) > 0


#: Bits to each member, and the least and greatest log2 of the size, of a bit array that is sized by its members.
ROOM, LEAST_BITS, MOST_BITS = 16, 10, 26


def room_for(n: int) -> int:
    """log2 of the bits for ``n`` hashes: ``ROOM`` bits each, up to 2^``MOST_BITS`` bits (8 MB)."""
    return min(max(int(np.ceil(np.log2(max(n, 1) * ROOM))), LEAST_BITS), MOST_BITS)


def collect_bitmap(df, column: str, bits: int | None = None) -> Bitmap:
    """Bits of the hashes in ``column``, or-ed on the executors; the driver gets 2^bits / 8 bytes at most.

    Without ``bits`` the array is sized by the number of rows. Beyond
    2^``MOST_BITS`` bits it stays as it is and says yes more often, which costs
    time and never a result.
    """
    from pyspark.sql import functions as F

    bits = room_for(df.count()) if bits is None else bits
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = df.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
    table = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(max(1, (1 << bits) >> 6), np.int64)
    if table.num_rows:
        words[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return Bitmap(bits, words.view(U))
