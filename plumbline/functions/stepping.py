"""Maps between states held as runs: the states of a counted repeat are consecutive numbers, and a symbol moves them all
by one. A run (start, target, slope) sends the states from start up to the next run to target + slope * (state - start), with
slope 0 or 1, so a map costs as much as it has runs, whatever the counts; maps compose into maps."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence

import numpy as np

#: Composed maps and sets remembered at a time; forgetting them costs time only.
MEMO = 20_000
#: Groups stepped together in one numpy operation; fewer are walked one by one.
TOGETHER = 16

Map = tuple[np.ndarray, np.ndarray, np.ndarray]
Ranges = tuple[tuple[int, int], ...]


def compact(start: np.ndarray, target: np.ndarray, slope: np.ndarray) -> Map:
    """The same map with neighbouring runs put together."""
    same = (slope[1:] == slope[:-1]) & (target[1:] - target[:-1] == slope[1:] * (start[1:] - start[:-1]))
    kept = np.concatenate([[True], ~same])
    return start[kept], target[kept], slope[kept]


def then(a: Map, b: Map, size: int) -> Map:
    """First a, then b, over states 0 to size - 1."""
    start, target, slope = a
    last = target + slope * (np.append(start[1:], size) - start - 1)
    low = np.searchsorted(b[0], target, "right") - 1
    n = np.searchsorted(b[0], last, "right") - low
    of = np.repeat(np.arange(len(start)), n)
    j = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    image = np.maximum(target[of], b[0][j])
    return compact(start[of] + image - target[of], b[1][j] + b[2][j] * (image - b[0][j]), slope[of] * b[2][j])


def value(m: Map, state: int) -> int:
    i = int(np.searchsorted(m[0], state, "right")) - 1
    return int(m[1][i] + m[2][i] * (state - m[0][i]))


def united(ranges: Iterable[tuple[int, int]]) -> Ranges:
    """Half-open ranges in order, without overlap."""
    out: list[list[int]] = []
    for low, high in sorted(r for r in ranges if r[0] < r[1]):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return tuple((a, b) for a, b in out)


def inside(ranges: Ranges, state: int) -> bool:
    i = bisect_right(ranges, (state, float("inf"))) - 1
    return i >= 0 and ranges[i][0] <= state < ranges[i][1]


def preimage(m: Map, wanted: Ranges, size: int) -> Ranges:
    """States that the map sends into the wanted ones."""
    start, target, slope = m
    end = np.append(start[1:], size)
    found = []
    for low, high in wanted:
        steady = (slope == 0) & (target >= low) & (target < high)
        found += zip(start[steady].tolist(), end[steady].tolist(), strict=True)
        moving = slope == 1
        a = np.maximum(start[moving], start[moving] + low - target[moving])
        b = np.minimum(end[moving], start[moving] + high - target[moving])
        some = a < b
        found += zip(a[some].tolist(), b[some].tolist(), strict=True)
    return united(found)


class Steps:
    """The transitions of a model: one map per symbol class."""

    def __init__(self, size: int, maps: Sequence[Sequence[tuple[int, int, int]]]):
        self.size = size
        self.maps: list[Map] = [compact(*np.array(m, np.int64).T) for m in maps]
        self._index()

    def _index(self) -> None:
        self.key = np.concatenate([c * self.size + m[0] for c, m in enumerate(self.maps)])
        self.start, self.target, self.slope = (np.concatenate([m[i] for m in self.maps]) for i in range(3))
        self.lists = [tuple(a.tolist() for a in m) for m in self.maps]
        self.powers: dict[tuple[int, int], Map] = {}
        self.composed: dict[tuple, Map] = {}
        self.backward: dict[tuple, Ranges] = {}

    def __getstate__(self):
        return self.size, self.maps

    def __setstate__(self, held):
        self.size, self.maps = held
        self._index()

    def step(self, state: np.ndarray, cls) -> np.ndarray:
        """Next states of many states at once; one class, or one for each."""
        i = np.searchsorted(self.key, np.asarray(cls) * self.size + state, "right") - 1
        return self.target[i] + self.slope[i] * (state - self.start[i])

    def one(self, state: int, c: int) -> int:
        start, target, slope = self.lists[c]
        i = bisect_right(start, state) - 1
        return target[i] + slope[i] * (state - start[i])

    def trace(self, cls: Sequence[int], state: int) -> np.ndarray:
        """State after every row; rows of one class that follow each other are counted at once."""
        cls = np.asarray(cls, np.int64)
        out = np.empty(len(cls), np.int64)
        at = 0
        for c, n in runs(cls):
            start, target, slope = self.lists[c]
            while n:
                i = bisect_right(start, state) - 1
                if slope[i] and target[i] == start[i] + 1:
                    m = min(n, (start[i + 1] if i + 1 < len(start) else self.size) - state)
                    out[at:at + m] = np.arange(state + 1, state + m + 1)
                    state += m
                elif (to := target[i] + slope[i] * (state - start[i])) == state:
                    m = n
                    out[at:at + m] = state
                else:
                    m, out[at], state = 1, to, to
                at, n = at + m, n - m
        return out

    def traces(self, groups: Sequence[Sequence[int]], entries: Sequence[int]) -> list[np.ndarray]:
        """`trace` of many groups: all rows at one place of their groups are stepped together."""
        lengths = np.array([len(g) for g in groups], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([np.asarray(groups[i], np.int64) for i in order]) if len(order) else np.zeros(0, np.int64)
        first = np.cumsum(lengths[order]) - lengths[order]
        state = np.asarray(entries, np.int64)[order]
        out = np.empty(len(flat), np.int64)
        active, at = len(order), 0
        while True:
            while active and lengths[order[active - 1]] <= at:
                active -= 1
            if active < TOGETHER:
                break
            rows = first[:active] + at
            state[:active] = self.step(state[:active], flat[rows])
            out[rows] = state[:active]
            at += 1
        for i in range(active):
            rest = slice(first[i] + at, first[i] + lengths[order[i]])
            out[rest] = self.trace(flat[rest], int(state[i]))
        made: list = [None] * len(order)
        for i, j in enumerate(order):
            made[j] = out[first[i]:first[i] + lengths[j]]
        return made

    def power(self, c: int, n: int) -> Map:
        """n rows of one class."""
        made = None
        for bit in range(n.bit_length()):
            if (c, bit) not in self.powers:
                half = self.powers.get((c, bit - 1))
                self.powers[c, bit] = self.maps[c] if bit == 0 else then(half, half, self.size)
            if n >> bit & 1:
                made = self.powers[c, bit] if made is None else then(made, self.powers[c, bit], self.size)
        return made

    def chunk_map(self, cls: Sequence[int]) -> Map:
        """Entry state to exit state over a chunk."""
        m = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64))
        for c, n in runs(np.asarray(cls, np.int64)):
            key = (m[0].tobytes(), m[1].tobytes(), m[2].tobytes(), c, n)
            if key not in self.composed:
                if len(self.composed) >= MEMO:
                    self.composed.clear()
                self.composed[key] = then(m, self.power(c, n), self.size)
            m = self.composed[key]
        return m

    def before(self, wanted: Ranges, c: int) -> Ranges:
        """States from which a row of the class leads into the wanted ones."""
        found = self.backward.get((wanted, c))
        if found is None:
            if len(self.backward) >= MEMO:
                self.backward.clear()
            found = self.backward[wanted, c] = preimage(self.maps[c], wanted, self.size)
        return found

    def alive_before(self, cls: Sequence[int], alive: Ranges) -> list[Ranges]:
        """For every gap of the chunk, the states from which the rest can still be completed."""
        sets = [alive]
        for c in reversed(cls):
            sets.append(self.before(sets[-1], int(c)))
        return sets[::-1]


def runs(cls: np.ndarray) -> Iterable[tuple[int, int]]:
    """(class, how often in a row)."""
    if not len(cls):
        return
    edge = np.flatnonzero(cls[1:] != cls[:-1]) + 1
    at = np.concatenate([[0], edge])
    yield from zip(cls[at].tolist(), np.diff(np.append(at, len(cls))).tolist(), strict=True)
