"""Secrets by base patterns and dictionary-primed compression.

Base patterns find assignments to sensitive names, access keys and long
hexadecimal runs. Beyond them, any long run of key-like characters near a
sensitive word is a candidate. A candidate is measured by what it adds to a
zstandard frame: the surrounding text is compressed with and without it, both
primed with a dictionary of identifiers and the surrounding text itself.
Ordinary names and prose add little; keys add nearly their own length in bytes
and are reported as kind ``novel``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import spans as S
from .scratch import ship

KINDS = ("assign", "access", "hex", "novel")
BASE = KINDS[:3]
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", re.I | re.A)
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")
_SENSITIVE = re.compile(r"pass|pwd|secret|token|key|auth|credential|bearer|private|signature", re.I | re.A)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}+")
NEAR, AROUND, PIECE = 48, 512, 64
# Names that code uses, to prime the compressor.
IDENTIFIERS = """
access account action address admin algorithm application argument array assert async attribute auth authorization await
base64 bearer boolean buffer build byte cache callback catch certificate char checksum class client code column command
commit component config configuration connection const constructor container content context continue controller cookie
copy count credential data database date debug decode default define delete description dictionary digest directory
document double element else encode encoding endpoint environment error event example except exception execute export
extends false field file filter final float format from function generate group handler hash header host http https
identifier image implements import index info init initialize input insert instance integer interface internal item
iterator json key label lambda language length library license list local localhost logger login long main map match
message metadata method model module name namespace network node null number object offset option output override
package page parameter parent parse password path pattern payload permission pointer port prefix print private process
property protected protocol provider public query queue range read record redirect reference register release remove
replace repository request require resource response result return role route row schema script secret security select
sequence server service session setting signature size source start state static status stream string struct style
super switch system table target template test text thread throw timeout timestamp title token transaction true type
undefined unicode unique update upload url user username utf8 value variable vector version view virtual void warning
while width window worker write yield placeholder changeme your_api_key_here xxxxxxxxxxxxxxxx 0123456789abcdef
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
"""


def base_spans(text: str) -> list[S.Span]:
    """Matches of the base patterns that are long enough, leftmost and non-overlapping for each kind."""
    found: list[S.Span] = []
    if _NAMES.search(text):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return found


class Meter:
    """Marginal compressed bytes of a string in its surroundings."""

    def __init__(self, level: int = 3):
        self.level = level

    def added(self, text: str, start: int, end: int) -> int:
        """Bytes that a string adds; its copies nearby are blanked, and a long one is measured in pieces of at most ``PIECE``."""
        run = text[start:end]
        n = len(run)
        before = text[max(0, start - AROUND - n) : start].replace(run, " ")[-AROUND:]
        after = text[end : end + AROUND + n].replace(run, " ")[:AROUND]
        pieces = -(-n // PIECE)
        return sum(self._piece((before + run[max(0, a - AROUND) : a])[-AROUND:], run[a:b], (run[b : b + AROUND] + after)[:AROUND])
                   for a, b in ((n * k // pieces, n * (k + 1) // pieces) for k in range(pieces)))

    def _piece(self, before: str, piece: str, after: str) -> int:
        primer = (IDENTIFIERS + before + after).encode()
        words = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        squeeze = zstandard.ZstdCompressor(level=self.level, dict_data=words, write_content_size=False, write_checksum=False)
        tail = before[-NEAR:].encode()
        return len(squeeze.compress(tail + piece.encode())) - len(squeeze.compress(tail))


def novel_spans(text: str, base: list[S.Span], meter: Meter, ratio: float = 0.7) -> list[S.Span]:
    """Key-like runs near a sensitive word whose marginal bytes reach ``ratio`` of their length."""
    if not _SENSITIVE.search(text):
        return []
    added: list[S.Span] = []
    taken = S.Taken(base)
    for hit in _RUN.finditer(text):
        start, end = hit.span()
        run = hit[0].rstrip(".=-")
        end = start + len(run)
        kinds = (any(c.isdigit() for c in run), any(c.islower() for c in run), any(c.isupper() for c in run))
        if len(run) < 16 or sum(kinds) < 2 or taken.meets(start, end):
            continue
        if _SENSITIVE.search(text, max(0, start - NEAR), start) and meter.added(text, start, end) >= ratio * len(run):
            added.append((start, end, "novel"))
    return added


def _kernel(ratio: float):
    def kernel(batches):
        meter = Meter()
        for batch in batches:
            counts, sha, every = [], [], []
            for text in batch.column("_text").to_pylist():
                base = base_spans(text) if text else []
                added = novel_spans(text, base, meter, ratio) if text else []
                serial = S.serial(base, KINDS)
                counts.append([sum(s[2] == k for s in base) for k in BASE])
                sha.append(S.digest(serial))
                every.append(S.serial(base + added, KINDS) if added else serial)
            numbers = np.array(counts, np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(numbers[:, k]) for k in range(len(BASE))), pa.array(sha, pa.string()), pa.array(every, pa.string())],
                ["_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return kernel


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex (base spans), base_sha256, spans.

    Null and empty texts have no spans. Repeated rows and null ids pass through;
    an empty table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = f"_id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string"
    return rows.mapInArrow(_kernel(ratio), schema).withColumnRenamed("_id", id_col)
