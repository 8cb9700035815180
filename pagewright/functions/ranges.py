"""Page-range expressions, on the driver for a literal count and as columns for a varying one."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


class RangeError(ValueError):
    """A range expression that cannot be read or names a page that does not exist."""


def _number(token: str, count: int) -> int:
    token = token.strip()
    if token == "first":
        return 0
    if token == "last":
        return count - 1
    from_end = token.startswith("r")
    digits = token[1:] if from_end else token
    if not re.fullmatch(r"\+?[0-9]+", digits):
        raise RangeError(f"not a page range: {token!r}")
    k = int(digits)
    if not 1 <= k <= count:
        raise RangeError(f"page {k} of {count}")
    return count - k if from_end else k - 1


def parse(spec: str, count: int) -> list[int]:
    """Zero-based pages in the order written, duplicates kept; nothing for an empty document."""
    pages: list[int] = []
    for part in (p.strip() for p in spec.split(",")) if count else ():
        if not part:
            continue
        if part in ("all", "*"):
            pages += range(count)
        elif part in ("odd", "even"):
            pages += range(part == "even", count, 2)
        elif "-" in part and not part.startswith("r"):
            low, _, high = part.partition("-")
            a = _number(low, count) if low.strip() else 0
            b = _number(high, count) if high.strip() else count - 1
            pages += range(a, b + 1) if a <= b else range(a, b - 1, -1)
        else:
            pages.append(_number(part, count))
    return pages


def _bound(token: str, n: Column) -> Column:
    """The zero-based page of one token as a column of the page count ``n``; an error outside the document."""
    token = token.strip()
    if token == "first":
        return F.lit(0)
    if token == "last":
        return n - 1
    from_end = token.startswith("r")
    digits = token[1:] if from_end else token
    if not re.fullmatch(r"\+?[0-9]+", digits):
        raise RangeError(f"not a page range: {token!r}")
    k = int(digits)
    value = n - k if from_end else F.lit(k - 1)
    wrong = F.raise_error(F.concat(F.lit(f"page {k} of "), n.cast("string"))).cast("int")
    return F.when((F.lit(k) >= 1) & (F.lit(k) <= n), value).otherwise(wrong)


def expand(spec: str, n: Column, strict: bool = True) -> Column:
    """The pages of ``spec`` as an array column for a page-count column ``n``.

    ``strict`` fails on a page outside the document; otherwise the part that
    names one is skipped. An empty document has no pages whatever the expression.
    """
    n = n.cast("int")
    parts = []
    for part in (p.strip() for p in spec.split(",")):
        if not part:
            continue
        if part in ("all", "*"):
            parts.append(F.sequence(F.lit(0), n - 1))
        elif part == "odd":
            parts.append(F.sequence(F.lit(0), n - 1, F.lit(2)))
        elif part == "even":
            parts.append(F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(2))).otherwise(F.array().cast("array<int>")))
        elif "-" in part and not part.startswith("r"):
            low, _, high = part.partition("-")
            a = _bound(low, n) if low.strip() else F.lit(0)
            b = _bound(high, n) if high.strip() else n - 1
            parts.append(F.sequence(a.cast("int"), b.cast("int")))
        else:
            parts.append(F.array(_bound(part, n).cast("int")))
    empty = F.array().cast("array<int>")
    whole = F.concat(*parts) if parts else empty
    if not strict:
        fits = []
        for part, column in zip([p.strip() for p in spec.split(",") if p.strip()], parts):
            numbers = [int(d) for d in re.findall(r"[0-9]+", part)]
            fits.append(F.when(F.lit(max(numbers, default=0)) <= n, column).otherwise(empty))
        whole = F.concat(*fits) if fits else empty
    return F.when(n > 0, whole).otherwise(empty)
