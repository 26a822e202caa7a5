"""Order models for groups of rows, compiled on the driver to a small transition table.

A model is a regular expression over symbols: elem, seq, choice, wildcard, each with occurrence
bounds. Its states are found by taking derivatives of the expression. A symbol repeated with bounds
is one block of states, one for each count, that is never listed: transitions are held as runs of
states (see `stepping`), so the counts of a model may be of any size. What reaches the executors is
these runs, or the written-out table of a small model, not the expression.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.stepping import Ranges, Steps, inside, united

#: Different expressions of a model, counts of single symbols left out; beyond it compiling raises, it never loosens.
EXPRESSIONS = 50_000
#: Entries of a transition table that is written into plans; larger models are stepped in Arrow batches.
LITERALS = 4000
OTHER = "\x00other"

EPS, NONE = ("eps",), ("none",)


def elem(name: str, lo: int = 1, hi: int | None = 1, substitutes: Sequence[str] = (), abstract: bool = False):
    """One row called `name`, or one of its substitutes; an abstract name only lends its place."""
    names = tuple(dict.fromkeys(([] if abstract else [name]) + list(substitutes)))
    return _rep(("sym", names, None, False) if names else NONE, lo, hi)


def wildcard(lo: int = 1, hi: int | None = 1, excluding: Sequence[str] = (), only: Sequence[str] | None = None):
    """Any row, any but some, or any of a list, without suggesting names."""
    return _rep(("sym", tuple(only) if only is not None else None, frozenset(excluding), True) if only is None or len(only) else NONE, lo, hi)


def seq(*parts, lo: int = 1, hi: int | None = 1):
    out = EPS
    for p in reversed(parts):
        out = _cat(p, out)
    return _rep(out, lo, hi)


def choice(*parts, lo: int = 1, hi: int | None = 1):
    return _rep(_alt(parts, canonical=False), lo, hi)


def _nullable(n) -> bool:
    kind = n[0]
    if kind == "eps":
        return True
    if kind in ("none", "sym"):
        return False
    if kind == "cat":
        return _nullable(n[1]) and _nullable(n[2])
    if kind == "alt":
        return any(_nullable(p) for p in n[1])
    return n[2] == 0 or _nullable(n[1])


def _cat(a, b):
    if a == NONE or b == NONE:
        return NONE
    if a == EPS:
        return b
    if b == EPS:
        return a
    if a[0] == "cat":
        return _cat(a[1], _cat(a[2], b))
    return ("cat", a, b)


def _alt(parts, canonical=True):
    flat = []
    for p in parts:
        for q in (p[1] if p[0] == "alt" else (p,)):
            if q != NONE and q not in flat:
                flat.append(q)
    if not flat:
        return NONE
    if len(flat) == 1:
        return flat[0]
    return ("alt", tuple(sorted(flat, key=repr) if canonical else flat))


def _rep(n, lo, hi):
    if hi is not None and lo > hi:
        raise ValueError(f"occurrence range {lo}..{hi} is empty")
    if hi == 0 or n == EPS:
        return EPS
    if n == NONE:
        return EPS if lo == 0 else NONE
    if _nullable(n):
        lo = 0
    if (lo, hi) == (1, 1):
        return n
    if n[0] == "rep" and n[2] == 0 and n[3] is None:
        return n
    return ("rep", n, lo, hi)


def _derive(n, accepts):
    kind = n[0]
    if kind in ("eps", "none"):
        return NONE
    if kind == "sym":
        return EPS if accepts(n) else NONE
    if kind == "cat":
        left = _cat(_derive(n[1], accepts), n[2])
        return _alt((left, _derive(n[2], accepts))) if _nullable(n[1]) else left
    if kind == "alt":
        return _alt([_derive(p, accepts) for p in n[1]])
    rest = _rep(n[1], max(n[2] - 1, 0), None if n[3] is None else n[3] - 1)
    return _cat(_derive(n[1], accepts), rest)


def _symbols(n):
    if n[0] == "sym":
        yield n
    elif n[0] == "alt":
        for p in n[1]:
            yield from _symbols(p)
    elif n[0] in ("cat", "rep"):
        for p in n[1:3] if n[0] == "cat" else n[1:2]:
            yield from _symbols(p)


def _counted(n):
    """(symbol, lo, hi, rest) of an expression that begins with a symbol repeated more than once."""
    lead, rest = (n[1], n[2]) if n[0] == "cat" else (n, EPS)
    if lead[0] == "rep" and lead[1][0] == "sym" and (lead[3] or lead[2]) >= 2:
        return lead[1], lead[2], lead[3], rest
    return None


@dataclass(frozen=True)
class Model:
    """Transitions over symbol classes. State size - 1 is the dead one, from all others acceptance can be reached; 0 is the start."""

    names: tuple[str, ...]                              # class id -> symbol; the last class is everything else
    size: int
    maps: tuple[tuple[tuple[int, int, int], ...], ...]  # per class: runs (start, target, slope)
    accepts: Ranges                                     # accepting states
    suggested: tuple[Ranges, ...]                       # per class: states in which a named particle accepts it
    left: tuple[tuple[int, int | None, int], ...]       # runs (start, symbols of the shortest named continuation, slope 0 or -1)

    @property
    def dead(self) -> int:
        return self.size - 1

    @property
    def width(self) -> int:
        return len(self.names)

    @property
    def small(self) -> bool:
        """Whether the whole table may be written into a plan."""
        return self.size * self.width <= LITERALS

    @cached_property
    def steps(self) -> Steps:
        return Steps(self.size, self.maps)

    @property
    def live(self) -> Ranges:
        """States from which acceptance can still be reached."""
        return ((0, self.dead),) if self.dead else ()

    @cached_property
    def delta(self) -> tuple[tuple[int, ...], ...]:
        """The table of a small model, written out."""
        if not self.small:
            raise ValueError(f"a table of {self.size} states is not written out")
        return tuple(tuple(self.steps.one(s, c) for c in range(self.width)) for s in range(self.size))

    @cached_property
    def accepting(self) -> frozenset:
        """The accepting states of a small model, listed."""
        if not self.small:
            raise ValueError(f"{self.size} states are not listed")
        return frozenset(s for a, b in self.accepts for s in range(a, b))

    def options(self, state: int) -> list[int]:
        """Classes that a named particle accepts in this state."""
        return [c for c, states in enumerate(self.suggested) if inside(states, state)]

    def to_go(self, state: int) -> int | None:
        """Symbols of the shortest named continuation to acceptance; None where there is none."""
        starts = self._left_starts
        start, n, slope = self.left[_last_at(starts, state)]
        return None if n is None else n + slope * (state - start)

    @cached_property
    def _left_starts(self) -> list[int]:
        return [r[0] for r in self.left]

    def walk_out(self, state: int) -> Iterator[int]:
        """Classes of the shortest named continuation, one after another; declaration order breaks ties."""
        n = self.to_go(state)
        while n:
            c = next(c for c in self.options(state) if self.to_go(self.steps.one(state, c)) == n - 1)
            yield c
            state, n = self.steps.one(state, c), n - 1

    def shortest(self, state: int) -> tuple[str, ...] | None:
        return None if self.to_go(state) is None else tuple(self.names[c] for c in self.walk_out(state))

    @cached_property
    def completion(self) -> tuple[tuple[str, ...] | None, ...]:
        """Per state of a small model, the shortest named continuation."""
        return tuple(self.shortest(s) for s in range(len(self.delta)))

    def next_names(self, state: int) -> list[str]:
        """Named symbols legal after `state` that can still lead to acceptance."""
        return [self.names[c] for c in self.options(state) if self.steps.one(state, c) != self.dead]

    def class_of(self, sym: Column) -> Column:
        """Symbol text to class id."""
        known = self.names[:-1]
        table = F.create_map(*[x for i, n in enumerate(known) for x in (F.lit(n), F.lit(i))]) if known else None
        other = F.lit(len(known))
        return other if table is None else F.coalesce(F.try_element_at(table, sym), other)

    def table(self) -> Column:
        return F.array(*[F.lit(t) for row in self.delta for t in row])

    def step(self, state: Column, cls: Column) -> Column:
        return F.get(self.table(), state * F.lit(self.width) + cls)

    def is_accepting(self, state: Column) -> Column:
        out = F.lit(False)
        for a, b in self.accepts:
            out = out | ((state == a) if b == a + 1 else (state >= a) & (state < b))
        return out


def _last_at(starts: list[int], state: int) -> int:
    from bisect import bisect_right
    return bisect_right(starts, state) - 1


class _Blocks:
    """Expressions of a model as blocks of consecutive states: one state, or one for each count of a repeated symbol."""

    def __init__(self, names: Sequence[str]):
        self.names = names
        self.plain: dict[tuple, int] = {}
        self.families: dict[tuple, list[tuple[int, int | None, int]]] = {}
        self.blocks: list[tuple] = []  # (first state, states, expression)
        self.size = 0

    def takes(self, sym, c: int, named: bool = False) -> bool:
        _, only, excluding, wild = sym[:4]
        if named and wild:
            return False
        return self.names[c] in only if only is not None else self.names[c] not in excluding

    def derive(self, n, c: int, named: bool = False):
        return _derive(n, lambda s: self.takes(s, c, named))

    def count(self, n):
        """The counted symbol that heads a block, unless what follows begins with the same symbol."""
        found = _counted(n)
        if found:
            sym, lo, hi, rest = found
            if lo != hi and any(self.takes(sym, c) and self.derive(rest, c) != NONE for c in range(len(self.names))):
                return None
        return found

    def find(self, n) -> int | None:
        if n in self.plain:
            return self.plain[n]
        found = self.count(n)
        if found:
            sym, lo, hi, rest = found
            for first_lo, first_hi, base in self.families.get((sym, rest), ()):
                k = first_lo - lo if hi is None else (first_hi - hi if first_hi is not None else -1)
                if (hi is None) == (first_hi is None) and k >= 0 and max(first_lo - k, 0) == lo and (first_hi is None or k < first_hi):
                    return base + k
        return None

    def add(self, n) -> list:
        """A new block; returns the expressions behind it, the one met first last."""
        found, base = self.count(n), self.size
        if not found:
            self.plain[n] = base
            self.blocks.append((base, 1, n))
            self.size += 1
            return [d for c in reversed(range(len(self.names))) if (d := self.derive(n, c)) != NONE]
        sym, lo, hi, rest = found
        length = lo if hi is None else hi
        self.families.setdefault((sym, rest), []).append((lo, hi, base))
        self.blocks.append((base, length, n))
        self.size += length
        aside = [d for c in reversed(range(len(self.names))) if length > lo and not self.takes(sym, c) and (d := self.derive(rest, c)) != NONE]
        return [*aside, self.behind(found)]

    @staticmethod
    def behind(found):
        """The expression after the last count of a block."""
        sym, _, hi, rest = found
        return _cat(_rep(sym, 0, None), rest) if hi is None else rest


def compile_model(root, limit: int = EXPRESSIONS) -> Model:
    syms = list(_symbols(root))
    listed = [n for s in syms for n in (s[1] or ())] + [n for s in syms for n in sorted(s[2] or ())]
    names = (*dict.fromkeys(listed), OTHER)
    named_in = _declaration_order(root)
    names = (*[n for n in named_in if n in names], *[n for n in names if n not in named_in])

    b = _Blocks(names)
    waiting = [root] if root != NONE else []
    while waiting:
        n = waiting.pop()
        if b.find(n) is None:
            if len(b.blocks) >= limit:
                raise ValueError(f"the model has more than {limit} different expressions")
            waiting += b.add(n)
    dead = b.size
    if dead >= 1 << 31:
        raise ValueError("the counts of the model multiply beyond 2^31 states")
    maps: list[list] = [[] for _ in names]
    suggested: list[list] = [[] for _ in names]
    accepts, exits = [], []
    for base, length, n in b.blocks:
        found = b.count(n) if length > 1 or n not in b.plain else None
        sym, lo, _, rest = found or (None, 0, None, n)
        exits.append((base, length, lo, _nullable(rest) and length > lo, [], found is not None and not sym[3], b.find(b.behind(found)) if found else None))
        for c in range(len(names)):
            if found and b.takes(sym, c):
                maps[c].append((base, base + 1, 1))
                maps[c].append((base + length - 1, exits[-1][6], 1))  # one state, so of either slope
                if not sym[3]:
                    suggested[c].append((base, base + length))
                continue
            after = b.derive(rest, c) if length > lo else NONE
            if lo:
                maps[c].append((base, dead, 0))
            if length > lo:
                to = dead if after == NONE else b.find(after)
                maps[c].append((base + lo, to, 0))
                if c < len(names) - 1 and b.derive(rest, c, named=True) != NONE:
                    suggested[c].append((base + lo, base + length))
                    exits[-1][4].append(to)
        if exits[-1][3]:
            accepts.append((base + lo, base + length))
    for m in maps:
        m.append((dead, dead, 0))
    return Model(names, dead + 1, tuple(map(tuple, maps)), united(accepts), tuple(united(r) for r in suggested[:-1]) + ((),), _shortest(exits, dead))


def _shortest(blocks: list[tuple], dead: int) -> tuple[tuple[int, int | None, int], ...]:
    """Runs of the number of symbols left: along a block either the way out once enough are counted, or the way through it."""
    far = float("inf")
    starts = [base for base, *_ in blocks]
    out, through = [far] * len(blocks), [far] * len(blocks)  # from a state where counting may end; from the state behind the block

    def left(i: int, k: int):
        _, length, lo, *_, named, _ = blocks[i]
        owed = max(lo - k, 0)
        return min(out[i] + owed if named or not owed else far, through[i] + length - k if named else far)

    users: list[list[tuple[int, int]]] = [[] for _ in blocks]  # by block: (block that leads there, count it arrives at)
    for i, (_, _, _, _, targets, _, behind) in enumerate(blocks):
        for t in {*targets, *([behind] if behind is not None else [])}:
            j = _last_at(starts, t)
            users[j].append((i, t - starts[j]))
    queue = [(0, i) for i, x in enumerate(blocks) if x[3]]
    for _, i in queue:
        out[i] = 0
    heapq.heapify(queue)
    while queue:
        _, j = heapq.heappop(queue)
        for i, k in users[j]:
            new, changed = left(j, k), False
            at = starts[j] + k
            if at in blocks[i][4] and new + 1 < out[i]:
                out[i], changed = new + 1, True
            if at == blocks[i][6] and new < through[i]:
                through[i], changed = new, True
            if changed:
                heapq.heappush(queue, (min(out[i], through[i]), i))
    runs: list[tuple[int, int | None, int]] = []
    for i, (base, length, lo, *_) in enumerate(blocks):
        for k in sorted({0, lo, length - 1, *([int(length + through[i] - out[i])] if far not in (out[i], through[i]) else [])}):
            if 0 <= k < length:
                n = left(i, k)
                falls = k + 1 < length and n != far and left(i, k + 1) == n - 1
                runs.append((base + k, None if n == far else int(n), -1 if falls else 0))
    runs.append((dead, None, 0))
    return tuple(runs)


def allowed_pairs(model: Model) -> set[tuple[str, str]]:
    """Pairs of named symbols that may follow each other in a complete group; "^" starts and "$" ends one."""
    named = range(model.width - 1)
    to = lambda s, c: model.delta[s][c] if model.delta[s][c] != model.dead else None
    reached, waiting = {0}, [0]
    while waiting:
        s = waiting.pop()
        for t in model.delta[s]:
            if t != model.dead and t not in reached:
                reached.add(t)
                waiting.append(t)
    out = {("^", model.names[c]) for c in named if to(0, c) is not None}
    for s in reached:
        for c in named:
            t = to(s, c)
            if t is not None:
                out |= {(model.names[c], "$")} if t in model.accepting else set()
                out |= {(model.names[c], model.names[d]) for d in named if to(t, d) is not None}
    return out


def _loosen(n):
    """Counted repeats become plain ones; which particles compete does not depend on the counts."""
    if n[0] == "cat":
        return _cat(_loosen(n[1]), _loosen(n[2]))
    if n[0] == "alt":
        return _alt([_loosen(p) for p in n[1]])
    if n[0] == "rep":
        return _rep(_loosen(n[1]), min(n[2], 1), 1 if n[3] == 1 else None)
    return n


def _declaration_order(root) -> list[str]:
    """Names in the order the model mentions them."""
    return list(dict.fromkeys(n for s in _symbols(root) if not s[3] for n in s[1]))


def ambiguous(root) -> list[str]:
    """Symbols two different particles of the model compete for at the same point."""
    counter = iter(range(10**9))

    def mark(n):
        if n[0] == "sym":
            return ("sym", n[1], n[2], n[3], next(counter))
        if n[0] == "cat":
            return ("cat", mark(n[1]), mark(n[2]))
        if n[0] == "alt":
            return ("alt", tuple(mark(p) for p in n[1]))
        if n[0] == "rep":
            return ("rep", mark(n[1]), n[2], n[3])
        return n

    root = mark(_loosen(root))
    syms = {s[4]: s for s in _symbols(root)}
    seen, queue, clash = {root}, deque([root]), set()
    def admits(s, name):
        return name in s[1] if s[1] is not None else name not in s[2]
    every = sorted({n for s in syms.values() for n in (s[1] or ())}) + [OTHER]
    while queue:
        n = queue.popleft()
        open_here = []
        for pos in syms:
            nxt = _derive(n, lambda s: s[4] == pos)
            if nxt != NONE:
                open_here.append(syms[pos])
                if nxt not in seen:
                    if len(seen) >= EXPRESSIONS:
                        raise ValueError(f"the model has more than {EXPRESSIONS} different expressions")
                    seen.add(nxt)
                    queue.append(nxt)
        for name in every:
            if sum(admits(s, name) for s in open_here) > 1:
                clash.add("any other" if name == OTHER else name)
    return sorted(clash)
