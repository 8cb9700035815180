"""Typed character spans of a text and their serial form."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

Span = tuple[int, int, str]  # start, end (exclusive), kind; code points


def serial(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the order of ``kinds``, comma-joined."""
    rank = {kind: i for i, kind in enumerate(kinds)}
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Taken:
    """Spans that others may not touch; spans of several kinds may overlap each other."""

    def __init__(self, spans: list[Span]):
        merged: list[list[int]] = []
        for start, end, _ in sorted(spans):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        self.starts, self.ends = [m[0] for m in merged], [m[1] for m in merged]

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start
