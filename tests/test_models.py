"""Learnt models, models with large counts and sparse repairs against direct versions of the same rules."""

import random
import re
import tracemalloc
from collections import deque

import pytest
from pyspark.sql import functions as F

from plumbline.functions import model as M
from plumbline.functions import observed
from plumbline.functions.model import choice, compile_model, elem, seq, wildcard
from plumbline.functions import repairs as R
from plumbline.functions.repairs import Repairer
from plumbline.functions.stepping import inside, value
from plumbline.operators import profile as P
from plumbline.operators import sequence as Q


# --- learnt models ----------------------------------------------------------------------------------

def single(rng, names, depth=3):
    """A random expression that names every symbol once."""
    if len(names) == 1:
        out = elem(names[0])
    else:
        cuts = sorted(rng.sample(range(1, len(names)), min(len(names) - 1, rng.randint(1, 2))))
        out = rng.choice([seq, choice])(*[single(rng, names[a:b], depth - 1) for a, b in zip([0, *cuts], [*cuts, len(names)])])
    lo, hi = rng.choice([(1, 1), (1, 1), (0, 1), (1, None), (0, None)])
    return seq(out, lo=lo, hi=hi)


def split(pairs):
    return ({b for a, b in pairs if a == "^"}, {a for a, b in pairs if b == "$"}, {(a, b) for a, b in pairs if a != "^" and b != "$"})


def accepts(m, word):
    state = 0
    for ch in word:
        state = m.steps.one(state, m.names.index(ch) if ch in m.names else m.width - 1)
    return inside(m.accepts, state)


def same_groups(a, b):
    """Whether two models accept the same groups of one row at least."""
    names = dict.fromkeys(a.names[:-1] + b.names[:-1])
    cls = lambda m, n: m.names.index(n) if n in m.names else m.width - 1
    seen, waiting = {(0, 0)}, [(0, 0)]
    while waiting:
        s, t = waiting.pop()
        if (s, t) != (0, 0) and inside(a.accepts, s) != inside(b.accepts, t):
            return False
        for n in names:
            both = a.steps.one(s, cls(a, n)), b.steps.one(t, cls(b, n))
            if both not in seen:
                seen.add(both)
                waiting.append(both)
    return True


def test_single_occurrence_models_are_found_again():
    rng = random.Random(1)
    for _ in range(400):
        m = compile_model(single(rng, list("abcdefg"[:rng.randint(1, 7)])))
        pairs = M.allowed_pairs(m)
        if pairs:
            assert same_groups(m, compile_model(observed.learn(*split(pairs))))


def test_no_observed_group_falls_out():
    rng = random.Random(2)
    for _ in range(300):
        words = ["".join(rng.choice("abcde"[:rng.randint(1, 5)]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 8))]
        pairs = [p for w in words for p in zip(w, w[1:])]
        m = compile_model(observed.learn([w[0] for w in words], [w[-1] for w in words], pairs))
        assert all(accepts(m, w) for w in words)
        assert M.allowed_pairs(m) >= set(pairs) and len(m.names) == 1 + len(set("".join(words)))


def test_observed_model_of_a_table(spark):
    rows = [(k, i, ch) for k, w in {1: "sab", 2: "abab", None: "sab"}.items() for i, ch in enumerate(w)] + [(4, 0, "s"), (4, 1, None), (4, 2, "b")]
    df = spark.createDataFrame(rows, "k int, o int, s string")
    root = P.observed_model(df, ["k"], "o", "s")
    model = compile_model(root)
    assert accepts(model, "sab") and not accepts(model, "ba")
    for cut in (None, 2):
        assert P.observed_edges(df, ["k"], "o", "s", cut).count() == P.observed_edges(df, ["k"], "o", "s").count()
        assert all(r["valid"] for r in Q.sequence_valid(Q.Groups(df, ["k"], "o", "s", model, chunk_rows=cut)).collect())
    assert compile_model(P.observed_model(df.limit(0), ["k"], "o", "s")).accepts == ((0, 1),)
    with pytest.raises(ValueError):
        observed.learn([str(i) for i in range(observed.MAX_SYMBOLS + 1)], ["0"], [])


# --- counts -----------------------------------------------------------------------------------------

def counted(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        ch, (lo, hi) = rng.choice("abc"), rng.choice([(1, 1), (0, 1), (0, None), (2, 5), (3, None), (0, 4), (3, 3)])
        return elem(ch, lo, hi), f"{ch}{{{lo},{'' if hi is None else hi}}}"
    parts = [counted(rng, depth - 1) for _ in range(rng.randint(1, 3))]
    lo, hi = rng.choice([(1, 1), (0, 1), (0, None), (1, 2), (2, 3)])
    make, mark = (seq, "") if rng.random() < 0.5 else (choice, "|")
    return make(*[p for p, _ in parts], lo=lo, hi=hi), f"(?:{mark.join(t for _, t in parts)}){{{lo},{'' if hi is None else hi}}}"


def nearest(m):
    """Named symbols left to acceptance, by search over single states."""
    before = {}
    for s in range(m.size):
        for c in m.options(s):
            before.setdefault(m.steps.one(s, c), set()).add(s)
    left = {s: 0 for s in range(m.size) if inside(m.accepts, s)}
    queue = deque(left)
    while queue:
        state = queue.popleft()
        for s in before.get(state, ()):
            if s not in left:
                left[s] = left[state] + 1
                queue.append(s)
    return [left.get(s) for s in range(m.size)]


def test_counted_models_against_re():
    rng = random.Random(12)
    for _ in range(250):
        root, text = counted(rng, 2)
        m, rx = compile_model(root), re.compile(f"(?:{text})\\Z")
        assert nearest(m) == [m.to_go(s) for s in range(m.size)], text
        for _ in range(15):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
            cls = [m.names.index(ch) if ch in m.names else m.width - 1 for ch in word]
            states = m.steps.trace(cls, 0).tolist()
            end = states[-1] if states else 0
            assert inside(m.accepts, end) == bool(rx.match(word)), (text, word)
            cut = rng.randint(0, len(cls))
            assert value(m.steps.chunk_map(cls[cut:]), value(m.steps.chunk_map(cls[:cut]), 0)) == end
            whole, alive = m.steps.chunk_map(cls), m.steps.alive_before(cls, m.live)[0]
            assert all(inside(alive, s) == (value(whole, s) != m.dead) for s in range(m.size))
        groups = [[rng.randrange(m.width) for _ in range(rng.randint(0, 9))] for _ in range(40)]
        entries = [rng.randrange(m.size) for _ in groups]
        assert [t.tolist() for t in m.steps.traces(groups, entries)] == [m.steps.trace(g, e).tolist() for g, e in zip(groups, entries)]


def test_large_models_stay_small():
    m = compile_model(elem("x", 2500, 3000))
    assert [n for n in range(3005) if accepts(m, "x" * n)] == list(range(2500, 3001))
    assert sum(map(len, compile_model(seq(elem("x", 10, 1_000_000_000), elem("y", 5, 10_000))).maps)) < 30
    assert not compile_model(elem("x", 0, 0, abstract=True)).options(0) and compile_model(elem("x", abstract=True)).accepts == ()
    with pytest.raises(ValueError):
        compile_model(seq(choice(seq(elem("a", 1, 3), elem("b")), elem("c")), lo=1, hi=100_000), limit=1000)
    with pytest.raises(ValueError):
        compile_model(elem("x", 0, 1 << 40))


LO, HI = 9_000, 10_000


@pytest.mark.parametrize("rows", [None, 3_000])
def test_counts_up_to_ten_thousand(spark, rows):
    """h x{9000,10000} t: every operator gives what counting gives, in whole and in cut groups."""
    model = compile_model(seq(elem("h"), elem("x", LO, HI), elem("t", 0, 1)))
    sizes = [0, 1, LO - 2, LO - 1, LO, HI - 1, HI, HI + 1, HI + 3, HI + 9]
    df = spark.range(len(sizes)).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.get(F.array(*map(F.lit, sizes)), F.col("id")))).alias("o"))
    df = df.withColumn("s", F.when(F.col("o") == 0, "h").otherwise("x"))
    g = Q.Groups(df, ["k"], "o", "s", model, chunk_rows=rows)
    assert not model.small and g.cut == (rows is not None)
    got = lambda out, c: {r["k"]: r[c] for r in out.collect()}
    assert got(Q.sequence_valid(g), "valid") == {k: LO <= n <= HI for k, n in enumerate(sizes)}
    assert got(Q.first_invalid(g), "first_invalid") == {k: HI + 1 if n > HI else None for k, n in enumerate(sizes)}
    assert {k: None if v is None else len(v) for k, v in got(Q.missing_to_complete(g), "missing").items()} == {k: None if n > HI else max(LO - n, 0) for k, n in enumerate(sizes)}
    assert got(Q.allowed_next(g), "allowed") == {k: [] if n > HI else ["x"] * (n < HI) + ["t"] * (n >= LO) for k, n in enumerate(sizes)}
    far = lambda n: max(LO - n, n - HI, 0)
    assert got(Q.repair_cost(g), "cost") == {k: far(n) if far(n) <= 4 else None for k, n in enumerate(sizes)}
    assert got(Q.sequence_trace(g).groupBy("k").agg(F.max("state").alias("m")), "m") == {k: model.dead if n > HI else n + 1 for k, n in enumerate(sizes)}
    few = Q.Groups(df.where("k in (1, 4, 6)"), ["k"], "o", "s", model, chunk_rows=rows)
    offered = {(r["k"], r["name"]): (r["gap"], r["label"]) for r in Q.insertion_plan(few).collect()}
    assert offered == {(1, "x"): (1, "required-missing"), (4, "x"): (1, "repeat"), (4, "t"): (LO + 1, "suggested"), (6, "t"): (HI + 1, "suggested")}


def test_table_in_the_plan_and_batches_give_the_same(spark, monkeypatch):
    """Operators of small models work from literals; above the limit the same comes from Arrow batches."""
    rng = random.Random(4)
    model = compile_model(seq(elem("a", 0, 1), seq(elem("b", 1, 3), elem("c"), lo=1, hi=None), choice(elem("d"), elem("e", 0, 2))))
    words = {k: "".join(rng.choice("abcbcde") for _ in range(rng.randint(1, 8))) for k in range(60)}
    df = spark.createDataFrame([(k, i, ch) for k, w in words.items() for i, ch in enumerate(w)], "k int, o int, s string").cache()
    rows = lambda op, cut: sorted(str(tuple(r)) for r in op(Q.Groups(df, ["k"], "o", "s", model, chunk_rows=cut)).collect())
    operators = [Q.sequence_valid, Q.first_invalid, Q.missing_to_complete, Q.allowed_next, lambda g: Q.placement_options(g, ["c", "d"])]
    small = [rows(op, None) for op in operators]
    monkeypatch.setattr(M, "LITERALS", 0)
    assert not model.small
    for op, want in zip(operators, small):
        assert rows(op, None) == want and rows(op, 3) == want


# --- repairs ----------------------------------------------------------------------------------------

def test_repairs_of_many_states_are_sparse():
    tracemalloc.start()
    model = compile_model(seq(elem("h"), elem("x", 1000, 1500), elem("t")))
    fixer, (h, x, t, other) = Repairer(model), range(4)
    assert model.size > 1500
    assert fixer.repair([h] + [x] * 998 + [t])[0] == 2
    assert fixer.repair([h] + [x] * 1200 + [other] + [x] * 100 + [t]) == (1, [("delete", 1201, None, other)])
    assert fixer.repair([h, *[x] * 1501, t])[0] == 1 and fixer.repair([h, *[x] * 1506, t]) is None
    chunks = [[h] + [x] * 500, [x] * 500, [x] * 503 + [t]]
    way = fixer.path([fixer.table(c, -1 if i == 0 else chunks[i - 1][-1]) for i, c in enumerate(chunks)])
    assert way[1] == 3
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_groups_share_the_layers_of_their_repairs(monkeypatch):
    """Rows far back are forgotten, so the work grows with the layers that differ, not with the groups."""
    rng, worked, filled = random.Random(3), [], Repairer.filled
    model = compile_model(seq(*[elem(c, 0, 4) for c in "abc"], elem("d", 0, 900)))
    words = [[c for c in range(4) for _ in range(rng.randint(0, 7))] for _ in range(400)]
    alone = [Repairer(model).repair(w) for w in words]
    monkeypatch.setattr(Repairer, "filled", lambda self, layer: worked.append(1) or filled(self, layer))
    fixer = Repairer(model)
    assert [fixer.repair(w) for w in words] == alone
    assert len(worked) < sum(map(len, words)) / 3
    monkeypatch.setattr(R, "MEMO", 50)
    assert [Repairer.repair(fixer, w) for w in words] == alone


def test_cut_repairs_cost_the_same():
    rng = random.Random(9)
    for root in (seq(elem("a", 2, 4), elem("b", 0, 3), wildcard(0, 1, excluding=["a"])), seq(choice(elem("a"), elem("b", 1, 2)), lo=2, hi=3),
                 seq(elem("a", 3, 3), elem("b", 0, None), elem("c"))):
        model = compile_model(root)
        fixer = Repairer(model)
        for _ in range(120):
            word = [rng.randrange(model.width) for _ in range(rng.randint(0, 9))]
            whole = fixer.repair(word)
            chunks = [word[i:i + 3] for i in range(0, len(word), 3)] or [[]]
            before = [-1, *(c[-1] for c in chunks[:-1])]
            way = fixer.path([fixer.table(c, p) for c, p in zip(chunks, before)])
            assert (way and way[1]) == (whole and whole[0])
            if way:
                assert sum(len(fixer.plan(c, a, b, p)) for c, p, a, b in zip(chunks, before, way[0], way[0][1:])) == way[1]
