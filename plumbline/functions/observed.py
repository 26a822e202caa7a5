"""Order models learnt from data: from first, last and following symbols to an expression that names every symbol once.

The observed pairs are the edges of an automaton with one state per symbol. Its states are merged step by step, each
carrying the expression it stands for: a state that follows itself repeats; a chain becomes a sequence; states with the same
neighbours become a choice; a state that every neighbour may pass by becomes optional. Neighbours are taken through states
that may be empty. Where no step applies exactly, the step that lets in the fewest new pairs is taken. No step loses a
word, so every observed group is valid under the model.
"""

from __future__ import annotations

from collections.abc import Iterable

from plumbline.functions import model as M

#: Symbols above which learning is refused: such columns hold values, not names of rows.
MAX_SYMBOLS = 200


class _Graph:
    """States as bits of whole numbers: 0 is the start, 1 the end, the others carry expressions."""

    def __init__(self, first: Iterable, last: Iterable, pairs: Iterable[tuple]):
        pairs = list(pairs)
        names = sorted({*first, *last, *(x for p in pairs for x in p)}, key=lambda n: (n is None, n))
        if len(names) > MAX_SYMBOLS:
            raise ValueError(f"{len(names)} different symbols; a model is learnt from {MAX_SYMBOLS} at most")
        at = {n: i + 2 for i, n in enumerate(names)}
        #: per state: (expression, may repeat, may be empty); the expression itself is neither
        self.label = {i: (("name", n), False, False) for n, i in at.items()}
        self.succ = {i: 0 for i in (0, 1, *at.values())}
        for n in first:
            self.succ[0] |= 1 << at[n]
        for n in last:
            self.succ[at[n]] |= 2
        for a, b in pairs:
            self.succ[at[a]] |= 1 << at[b]

    def pred(self) -> dict[int, int]:
        out = dict.fromkeys(self.succ, 0)
        for s, row in self.succ.items():
            for t in bits(row):
                out[t] |= 1 << s
        return out

    def closed(self) -> tuple[dict[int, int], dict[int, int]]:
        """Followers and predecessors through states that may be empty; a state that repeats follows itself."""
        succ = dict(self.succ)
        for s, (_, repeats, _) in self.label.items():
            if repeats:
                succ[s] |= 1 << s
        for via, (_, _, empty) in self.label.items():
            if empty:
                for s in succ:
                    if succ[s] >> via & 1:
                        succ[s] |= succ[via]
        pred = dict.fromkeys(succ, 0)
        for s, row in succ.items():
            for t in bits(row):
                pred[t] |= 1 << s
        return succ, pred

    # --- steps ------------------------------------------------------------------------------------

    def repeat(self, s: int) -> None:
        expr, _, empty = self.label[s]
        if expr[0] == "choice":  # inside a repeat, members need neither repeat nor be empty
            empty = empty or any(e for _, _, e in expr[1])
            expr = ("choice", tuple((x, False, False) for x, _, _ in expr[1]))
        self.label[s] = expr, True, empty
        self.succ[s] &= ~(1 << s)

    def join(self, chain: list[int]) -> None:
        """A sequence takes the place of its first state."""
        parts = [p for s in chain for p in (self.label[s][0][1] if self.label[s][0][0] == "seq" and not self.label[s][1] and self.label[s][2] == all(e for _, _, e in self.label[s][0][1]) else (self.label[s],))]
        self.label[chain[0]] = ("seq", tuple(parts)), False, all(e for _, _, e in parts)
        back = self.succ[chain[-1]] >> chain[0] & 1
        self.succ[chain[0]] = self.succ[chain[-1]] & ~(1 << chain[0]) | back << chain[0]
        for s in chain[1:]:
            del self.succ[s], self.label[s]
        self.drop_implied()

    def merge(self, group: list[int]) -> None:
        """A choice takes the place of its first state; pairs among its members become a pair with itself."""
        members, empty = [], False
        for s in group:
            expr, repeats, may_be_empty = self.label[s]
            empty = empty or may_be_empty
            members += expr[1] if expr[0] == "choice" and not repeats else [(expr, repeats, False)]
        keep, gone = group[0], group[1:]
        self.label[keep] = ("choice", tuple(members)), False, empty
        for s in gone:
            self.succ[keep] |= self.succ.pop(s)
            del self.label[s]
        for s, row in self.succ.items():
            if any(row >> g & 1 for g in gone):
                self.succ[s] = row & ~sum(1 << g for g in gone) | 1 << keep
        self.drop_implied()

    def skip(self, s: int) -> None:
        expr, repeats, _ = self.label[s]
        self.label[s] = expr, repeats, True
        self.drop_implied()

    def drop_implied(self) -> None:
        """Pairs that a way around through states that may be empty allows as well need no edge; one by one, so that no way is lost."""
        empties = sum(1 << s for s, (_, _, empty) in self.label.items() if empty)
        for p in self.succ:
            for q in bits(self.succ[p]):
                rest = self.succ[p] & ~(1 << q)
                seen, reach, todo = 1 << p, 0, rest & empties & ~(1 << p)
                while todo and not reach >> q & 1:
                    n = todo.bit_length() - 1
                    seen |= 1 << n
                    reach |= self.succ[n]
                    todo = (todo | self.succ[n] & empties) & ~seen
                if reach >> q & 1:
                    self.succ[p] = rest

    # --- search -----------------------------------------------------------------------------------

    def exact_step(self) -> bool:
        for s in self.label:
            if self.succ[s] >> s & 1:
                self.repeat(s)
                return True
        pred = self.pred()
        single = lambda row: row and not row & (row - 1)
        for s in self.label:
            if single(pred[s]) and (p := pred[s].bit_length() - 1) in self.label and single(self.succ[p]):
                continue  # inside a chain that begins earlier, or on a ring
            chain, here = [s], s
            while single(self.succ[here]) and (t := self.succ[here].bit_length() - 1) in self.label and single(pred[t]) and t not in chain:
                chain.append(t)
                here = t
            if len(chain) > 1:
                self.join(chain)
                return True
        succ, back = self.closed()
        for own in (-1, 0):  # members that follow each other and themselves; members that do not follow each other
            same: dict[tuple[int, int], list[int]] = {}
            for s in self.label:
                mask = ~(1 << s) | own
                same.setdefault((succ[s] & mask, back[s] & mask), []).append(s)
            for group in same.values():
                if len(group) > 1:
                    self.merge(group)
                    return True
        for s, (_, _, empty) in self.label.items():
            if not empty and not self.passed_by(s, succ, back):
                self.skip(s)
                return True
        return False

    @staticmethod
    def passed_by(s: int, succ: dict[int, int], pred: dict[int, int]) -> int:
        """Pairs that are missing for the state to be optional."""
        after = succ[s] & ~(1 << s)
        return sum((after & ~succ[p]).bit_count() for p in bits(pred[s] & ~(1 << s)))

    def loosest_step(self) -> None:
        """The step that lets in the fewest pairs: one state made optional, or two made a choice."""
        succ, pred = self.closed()
        options = []
        for s, (_, _, empty) in self.label.items():
            if not empty:
                options.append((self.passed_by(s, succ, pred), 0, s, s))
        states = list(self.label)
        for i, s in enumerate(states):
            for t in states[i + 1:]:
                options.append(((succ[s] ^ succ[t]).bit_count() + (pred[s] ^ pred[t]).bit_count(), 1, s, t))
        _, kind, s, t = min(options)
        if kind:
            self.merge([s, t])
        else:
            self.skip(s)


def bits(row: int) -> Iterable[int]:
    while row:
        low = row & -row
        yield low.bit_length() - 1
        row ^= low


def learn(first: Iterable, last: Iterable, pairs: Iterable[tuple]):
    """An expression for `compile_model`; symbols that are NULL become rows of any other name. Nothing observed gives an
    empty sequence."""
    g = _Graph(list(first), list(last), pairs)
    while len(g.label) > 1 or any(g.succ[s] >> s & 1 for s in g.label):
        if not g.exact_step():
            g.loosest_step()
    names = sorted(n for n in _names(g.label.values()) if n is not None)

    def build(label):
        expr, repeats, empty = label
        lo, hi = 0 if empty else 1, None if repeats else 1
        if expr[0] == "name":
            return M.wildcard(lo, hi, excluding=names) if expr[1] is None else M.elem(expr[1], lo, hi)
        return (M.seq if expr[0] == "seq" else M.choice)(*map(build, expr[1]), lo=lo, hi=hi)

    return build(next(iter(g.label.values()))) if g.label else M.seq()


def _names(labels) -> Iterable:
    for expr, _, _ in labels:
        if expr[0] == "name":
            yield expr[1]
        else:
            yield from _names(expr[1])
