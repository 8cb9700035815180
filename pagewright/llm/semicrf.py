"""Personal data by base patterns and a semi-Markov conditional random field.

Base patterns find e-mail addresses, IP addresses, card numbers and phone
numbers; a match that fails its check is dropped. The model looks for more:
around digits and at-signs a text is cut into tokens, every run of up to
``LONGEST`` tokens is a candidate segment of each kind, features see the whole
segment (checksum, grouping, separators, neighbours), and Viterbi's algorithm
over segmentations chooses boundaries and kinds together. Its weights maximise
the conditional likelihood of generated examples with entities in forms that the
base patterns miss, next to decoys (dates, prices, versions, years). Found
segments that touch no base span are added.

Matching and decoding are linear in the text, and hold a few numbers a token:
patterns start at the first character of a run only, segments are bounded, and
features are made for a block of tokens at a time.
"""

from __future__ import annotations

import math
import random
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import spans as S, textkernels as T
from .scratch import ship

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
REACH = 24  # characters before a segment in which a cue counts

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[S.Span]:
    """Matches of the base patterns that pass their checks, leftmost and non-overlapping for each kind."""
    found: list[S.Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        hit = _DOMAIN.match(text, at) if start < at else None
        if hit:
            found.append((start, hit.end(), "email"))
            last = hit.end()
        else:
            last = at + 1
        at = text.find("@", max(last, at + 1))
    for hit in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in hit[0].split(".")):
            found.append((*hit.span(), "ip"))
    for hit in _CARD.finditer(text):
        if hit.end() - hit.start() <= 40:
            digits = _DIGITS.sub("", hit[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*hit.span(), "card"))
    for hit in _PHONE.finditer(text):
        digits = _DIGITS.sub("", hit[0])
        if 9 <= len(digits) <= 15:
            found.append((*hit.span(), "phone"))
    return found


# ---- the model -------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")
_SEED = re.compile(r"[0-9]+|@|[\[( ]at[\]) ]", re.I | re.A)
_IP4 = re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}")
_PHONE_SHAPE = re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}")
_DATE = re.compile(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}")
_MAIL_SHAPE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]* ?(?:@|\[at\]|\(at\)| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]+)+", re.I | re.A)
_AT = re.compile(r"@|[\[( ]at[\]) ]", re.I | re.A)
_MAIL_END = re.compile(r"(?:\.|dot[\])]? ?)[A-Za-z]{2,6}$", re.I | re.A)
_CUE = {
    "email": re.compile(r"mail|contact|write", re.I), "ip": re.compile(r"\bip\b|address|host|server", re.I),
    "card": re.compile(r"card|visa|credit|pay", re.I), "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
}
FEATURES = ("bias", "tokens", "shape", "check", "digits_fit", "group3", "group4", "plain", "cut_left", "cut_right", "letters", "date",
            "parens", "dots", "cue", "wide")
F_AT = {name: i for i, name in enumerate(FEATURES)}


def _features(text: str, start: int, end: int, kind: str) -> np.ndarray | None:
    """Whole-span features; None for a span that cannot be of the kind."""
    piece = text[start:end]
    digits = _DIGITS.sub("", piece)
    if kind == "email":
        if not _MAIL_SHAPE.fullmatch(piece):
            return None
    elif kind == "ip":
        if not _IP4.fullmatch(piece):
            return None
    elif not (7 if kind == "phone" else 12) <= len(digits) <= 19 or any(c.isalpha() for c in piece):
        return None
    groups = [len(g) for g in re.findall(r"[0-9]+", piece)]
    before, after = text[start - 1 : start], text[end : end + 1]
    x = np.zeros(len(FEATURES))
    x[0] = 1
    x[1] = min(len(piece), 40) / 20
    x[2] = kind in ("email", "ip") or kind == "phone" and bool(_PHONE_SHAPE.fullmatch(piece)) or kind == "card" and bool(re.fullmatch(r"[0-9]{4}(?:[ .-]{1,2}[0-9]{3,6}){2,4}|[0-9]{12,19}", piece))
    if kind == "card":
        x[3] = luhn(digits)
    elif kind == "ip":
        x[3] = all(int(g) <= 255 for g in re.findall(r"[0-9]+", piece))
    elif kind == "email":
        x[3] = bool(_MAIL_END.search(piece))
    else:
        x[3] = len(digits) in (10, 11)
    x[4] = 9 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19
    x[5] = 3 in groups and groups[-1] == 4
    x[6] = len(groups) >= 3 and all(g == 4 for g in groups[:-1])
    x[7] = len(groups) == 1
    x[8] = bool(before) and (before.isalnum() or before in "+_/@#$€£.,")
    x[9] = bool(after) and (after.isalnum() or after in "_/@%" or after in ".,-" and text[end + 1 : end + 2].isalnum())
    x[10] = any(c.isalpha() for c in piece)
    x[11] = bool(_DATE.search(piece))
    x[12] = piece.startswith("(") or piece.startswith("+")
    x[13] = (_AT.split(piece, maxsplit=1)[-1] if kind == "email" else piece).count(".") / 3  # of an address, those after the at-sign
    x[14] = bool(_CUE[kind].search(text[max(0, start - REACH) : start]))
    x[15] = "  " in piece
    return x


class _Tokens:
    """Bounds of the tokens in [low, high) of a text, and counts up to each bound; a few numbers a token."""

    def __init__(self, text: str, low: int, high: int):
        self.text, self.bounds = text, array("q", (m.start() for m in _TOKEN.finditer(text, low, high)))
        self.n = len(self.bounds)
        self.bounds.append(high)
        self.blank = bytearray(text[b].isspace() for b in self.bounds[: self.n])
        self.digits, self.letters, self.ats = array("q", [0]), array("q", [0]), array("q", [0])
        for a, b in zip(self.bounds, self.bounds[1:]):
            first = text[a]
            self.digits.append(self.digits[-1] + (b - a if "0" <= first <= "9" else 0))
            self.letters.append(self.letters[-1] + first.isalpha())
            self.ats.append(self.ats[-1] + (b - a <= 2 and text[a:b].lower() in ("@", "at")))

    def starting(self, i: int, reach: dict[int, int]) -> list[tuple]:
        """Candidate segments (i, j, kind number, features) from token ``i``; no segment of a kind lacks what the kind needs.

        An address without spaces that lies in a longer one is no candidate: ``reach``
        has, by start, the farthest end of such addresses so far.
        """
        first, found = self.text[self.bounds[i]], []
        if self.blank[i] or not (first.isalnum() or first in "+("):
            return found
        spaced = False
        for j in range(i + 1, min(i + LONGEST, self.n) + 1):
            spaced = spaced or bool(self.blank[j - 1])
            if self.blank[j - 1] or not self.text[self.bounds[j] - 1].isalnum():
                continue
            d, numeric = self.digits[j] - self.digits[i], self.letters[j] == self.letters[i]
            may = (self.ats[j] > self.ats[i], numeric and 4 <= d <= 12, numeric and 12 <= d <= 19, numeric and 7 <= d <= 19)
            for k, kind in enumerate(KINDS):
                x = _features(self.text, self.bounds[i], self.bounds[j], kind) if may[k] else None
                if x is not None:
                    found.append((i, j, k, x))
                    if kind == "email" and not spaced:
                        reach[i] = j
        inside = max((end for start, end in reach.items() if start < i), default=-1)
        for old in [start for start in reach if start < i - LONGEST]:
            del reach[old]
        part = lambda f: KINDS[f[2]] == "email" and not any(self.blank[f[0] : f[1]]) and (f[1] < reach.get(i, -1) or f[1] <= inside)
        return [f for f in found if not part(f)]


def _lattice(text: str, low: int, high: int):
    """Token bounds in [low, high) and the candidate segments between them."""
    tokens, reach = _Tokens(text, low, high), {}
    return list(tokens.bounds), [f for i in range(tokens.n) for f in tokens.starting(i, reach)]


BLOCK = 512


def _decode(tokens: _Tokens, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation, as (i, j, kind number), by pushing from each token on; features are held for a block of tokens.

    Of equal values a token outside entities comes first, then the segment that begins first.
    """
    best, start, label, reach = array("d", bytes(8 * (tokens.n + 1))), array("q", [-1]) * (tokens.n + 1), bytearray(tokens.n + 1), {}
    for k in range(1, tokens.n + 1):
        best[k] = -math.inf
    for low in range(0, tokens.n, BLOCK):
        found = [tokens.starting(i, reach) for i in range(low, min(low + BLOCK, tokens.n))]
        score = iter(_scores([f for own in found for f in own], weights).tolist())
        for i, own in enumerate(found, low):
            for _, j, k, _ in own:
                value = best[i] + next(score)
                if value > best[j]:
                    best[j], start[j], label[j] = value, i, k
            if best[i] >= best[i + 1]:
                best[i + 1], start[i + 1] = best[i], -1
    out, j = [], tokens.n
    while j > 0:
        if start[j] < 0:
            j -= 1
        else:
            out.append((start[j], j, label[j]))
            j = start[j]
    return out[::-1]


def _scores(found, weights: np.ndarray) -> np.ndarray:
    if not found:
        return np.zeros(0)
    return np.einsum("nf,nf->n", np.array([f[3] for f in found]), weights[[f[2] for f in found]])


def _best(bounds, found, score) -> list[int]:
    """Viterbi over segmentations; a token outside entities scores 0."""
    n = len(bounds) - 1
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for c, f in enumerate(found):
        ending[f[1]].append(c)
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for c in ending[j]:
            value = best[found[c][0]] + score[c]
            if value > best[j]:
                best[j], back[j] = value, c
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append(back[j])
            j = found[back[j]][0]
    return out[::-1]


def _marginals(n: int, found, score) -> np.ndarray:
    """Probability of each candidate segment, by the forward and backward sums over segmentations."""
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for c, f in enumerate(found):
        by_end[f[1]].append(c)
        by_start[f[0]].append(c)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[found[c][0]] + score[c] for c in by_end[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(score[c] + behind[found[c][1]] for c in by_start[i])])
    return np.array([np.exp(ahead[f[0]] + s + behind[f[1]] - ahead[n]) for f, s in zip(found, score)])


def _example(rng: random.Random) -> tuple[str, list[S.Span]]:
    """A generated line with decoys and, often, one entity; its gold spans."""
    word = lambda: "".join(rng.choice("aeiourstlnmd") for _ in range(rng.randint(2, 8)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + number(14)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def entity() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            at, dot = rng.choice([("@", "."), (" at ", " dot "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", ".")])
            return f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'io'])}", kind
        if kind == "ip":
            return rng.choice([".", "[.]", " . "]).join(str(rng.randint(0, 255)) for _ in range(4)), kind
        if kind == "card":
            d = card()
            return rng.choice([d, " ".join([d[:4], d[4:8], d[8:12], d[12:]]), ".".join([d[:4], d[4:8], d[8:12], d[12:]]), "  ".join([d[:4], d[4:8], d[8:12], d[12:]])]), kind
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"{a}.{b}.{c}", f"+{number(2)} {number(4)} {number(6)}"]), kind

    def decoy() -> str:
        return rng.choice([
            f"{rng.randint(1900, 2030)}-{number(2)}-{number(2)}", f"${number(3)}.{number(2)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
            number(4), number(7), number(10), number(12), number(16), f"{number(2)}:{number(2)}:{number(2)}", f"{number(3)},{number(3)},{number(3)}",
            f"{number(2)}.{number(2)}.{number(4)}", f"look at {word()}.{word()}", f"{number(5)}-{number(7)}", f"{number(2)}/{number(2)}/{number(4)}",
            f"{number(2)} {number(2)} {number(3)} {number(3)}", f"#{number(9)}", f"{number(4)}-{number(4)}",
        ])

    parts = [(word(), None) for _ in range(rng.randint(2, 4))]
    parts += [(decoy(), None) for _ in range(rng.randint(0, 2))]
    if rng.random() < 0.7:
        parts.append(entity())
    rng.shuffle(parts)
    text, gold = "", []
    for piece, kind in parts:
        text += " " if text else ""
        if kind:
            gold.append((len(text), len(text) + len(piece), kind))
        text += piece
    return text + rng.choice(["", ".", ", " + word()]), gold


@lru_cache(maxsize=1)
def trained(examples: int = 400, epochs: int = 40, seed: int = 7, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """(kinds, features) weights by gradient ascent on the conditional log likelihood of generated lines."""
    rng = random.Random(seed)
    data = []
    for _ in range(examples):
        text, gold = _example(rng)
        bounds, found = _lattice(text, 0, len(text))
        if found:
            want = np.array([(bounds[f[0]], bounds[f[1]], KINDS[f[2]]) in gold for f in found], float)
            data.append((len(bounds) - 1, found, want, np.array([f[3] for f in found]), np.array([f[2] for f in found])))
    weights = np.zeros((len(KINDS), len(FEATURES)))
    total = np.full_like(weights, 1e-6)
    for _ in range(epochs):
        gradient = -decay * len(data) * weights
        for n, found, want, x, kind in data:
            p = _marginals(n, found, np.einsum("nf,nf->n", x, weights[kind]))
            np.add.at(gradient, kind, (want - p)[:, None] * x)
        total += gradient**2
        weights += rate * gradient / np.sqrt(total)
    return weights


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches of ``LONGEST`` tokens on both sides of digits and at-signs, merged: every segment that holds one lies in a stretch."""
    out: list[list[int]] = []
    n, turned = len(text), ""
    for hit in _SEED.finditer(text):
        low, high = hit.span()
        for token in islice(_TOKEN.finditer(text, high), LONGEST):
            high = token.end()
        if not out or low > out[-1][1]:
            turned = turned or text[::-1]
            for token in islice(_TOKEN.finditer(turned, n - low), LONGEST):
                low = n - token.end()
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def found_spans(text: str, weights: np.ndarray, base: list[S.Span]) -> list[S.Span]:
    """The model's segments that touch no base span."""
    added: list[S.Span] = []
    taken = S.Taken(base)
    for low, high in _regions(text):
        tokens = _Tokens(text, low, high)
        for i, j, k in _decode(tokens, weights):
            if not taken.meets(tokens.bounds[i], tokens.bounds[j]):
                added.append((tokens.bounds[i], tokens.bounds[j], KINDS[k]))
    return added


def _kernel(weights: np.ndarray):
    def kernel(batches):
        for batch in batches:
            counts, sha, every = [], [], []
            for text in batch.column("_text").to_pylist():
                base = base_spans(text) if text else []
                added = found_spans(text, weights, base) if text else []
                serial = S.serial(base, KINDS)
                counts.append([sum(s[2] == k for s in base) for k in KINDS])
                sha.append(S.digest(serial))
                every.append(S.serial(base + added, KINDS) if added else serial)
            numbers = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(numbers[:, k]) for k in range(len(KINDS))), pa.array(sha, pa.string()), pa.array(every, pa.string())],
                ["_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return kernel


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    Null and empty texts have no spans. Repeated rows and null ids pass through;
    an empty table gives an empty result; other columns are not read.
    """
    from pyspark.sql import functions as F

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = f"_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return rows.mapInArrow(_kernel(trained() if weights is None else weights), schema).withColumnRenamed("_id", id_col)
