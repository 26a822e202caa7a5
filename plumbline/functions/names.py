"""Name similarity for small driver-side lists (column names of a spec)."""

from __future__ import annotations

from collections.abc import Sequence


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a.lower(), 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b.lower(), 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def nearest(name: str, options: Sequence[str]) -> str | None:
    near = [(distance(name, o), i, o) for i, o in enumerate(options)]
    near = [n for n in near if n[0] <= min(3, max(1, max(len(name), len(n[2])) // 3))]
    return min(near)[2] if near else None
