"""Order models against Python's re, repairs against brute force, cut groups against whole ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions.model import ambiguous, choice, compile_model, elem, seq, wildcard
from plumbline.operators import sequence as Q

MODEL = seq(elem("a", 0, 1), seq(elem("b"), elem("c"), lo=1, hi=None), choice(elem("d"), elem("e", 0, 2)))
PATTERN = re.compile(r"a?(bc)+(d|e{0,2})\Z")


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    out = {}
    for k in range(100):
        s = "".join(rng.choice("abcbcdex") for _ in range(rng.randint(1, 9)))
        if rng.random() < 0.5:
            s = "bc" * rng.randint(1, 4) + rng.choice(["", "d", "e", "cb", "x"])
        out[k] = s
    return out


@pytest.fixture(scope="module")
def frame(spark, words):
    return spark.createDataFrame([(k, i * 10, ch) for k, s in words.items() for i, ch in enumerate(s)]
                                 + [(None, i, ch) for i, ch in enumerate("abcbbcd")], "k int, o int, s string").cache()


def groups(frame, rows=None):
    return Q.Groups(frame, ["k"], "o", "s", compile_model(MODEL), chunk_rows=rows)


def test_validity(frame, words):
    got = {r["k"]: r["valid"] for r in Q.sequence_valid(groups(frame)).collect()}
    assert got == {None: False, **{k: bool(PATTERN.match(s)) for k, s in words.items()}}


@pytest.mark.parametrize("operator", [Q.sequence_valid, Q.sequence_trace, Q.first_invalid, Q.missing_to_complete, Q.allowed_next, Q.allowed_at_gaps, Q.insertion_plan, Q.repair_cost])
def test_cut_groups_give_the_same(frame, operator):
    whole, cut = groups(frame), groups(frame, 3)
    assert cut.cut and not whole.cut
    rows = lambda g: sorted(str(tuple(r)) for r in operator(g).collect())
    assert rows(whole) == rows(cut)


def brute(word, limit=2):
    seen = ring = {word}
    for cost in range(limit + 1):
        if any(PATTERN.match(w) for w in ring):
            return cost
        made = set()
        for w in ring:
            for i in range(len(w) + 1):
                made.update(w[:i] + ch + w[i:] for ch in "abcde")
                if i < len(w):
                    made.add(w[:i] + w[i + 1:])
                    made.update(w[:i] + ch + w[i + 1:] for ch in "abcde")
                if i + 1 < len(w):
                    made.add(w[:i] + w[i + 1] + w[i] + w[i + 2:])
        ring, seen = made - seen, seen | made
    return None


def test_least_cost(frame, words):
    got = {r["k"]: r["cost"] for r in Q.repair_cost(groups(frame)).collect()}
    for k, s in words.items():
        if len(s) <= 7 and brute(s) is not None:
            assert got[k] == brute(s), s


@pytest.mark.parametrize("rows", [None, 3])
def test_repairs_validate(frame, words, rows):
    g = groups(frame, rows)
    arrays = frame.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("o", "s")))["s"].alias("arr"))
    done = Q.repair_plan(g).where("cost is not null").join(arrays, "k").withColumn("out", Q.apply_repair(F.col("arr"), F.col("edits"))).collect()
    assert len(done) > 30
    for r in done:
        assert PATTERN.match("".join(r["out"])), r
        assert len(r["edits"]) == r["cost"]
        for e in r["edits"]:
            assert e["kind"] == "insert" or r["arr"][e["index"]] == e["existing"]
            assert e["kind"] != "transpose" or r["arr"][e["index"] + 1] == e["name"]
            assert e["at"] == (e["index"] * 10 if e["index"] < len(r["arr"]) else None)


def test_less_destructive_repair_wins(spark):
    model = compile_model(seq(elem("item", 0, None), elem("total")))
    df = spark.createDataFrame([(1, 0, "item"), (1, 1, "item")], "k int, o int, s string")
    plan = Q.repair_plan(Q.Groups(df, ["k"], "o", "s", model)).first()
    assert [(e["kind"], e["name"]) for e in plan["edits"]] == [("insert", "total")]


def test_gives_up_beyond_the_limit(spark):
    model = compile_model(elem("a"))
    df = spark.createDataFrame([(1, i, "x") for i in range(9)], "k int, o int, s string")
    g = Q.Groups(df, ["k"], "o", "s", model)
    assert Q.repair_plan(g).first()["cost"] is None
    assert Q.sequence_findings(g).count() == 1


def test_purchase_order_messages(spark):
    model = compile_model(seq(elem("id"), elem("shipDate", 0, 1), elem("line", 1, None), elem("note", 0, 3)))
    cases = {"ok": "id line note", "wrong order": "line id", "missing line": "id", "stray": "id line nope", "too many": "id line note note note note"}
    rows = [(k, i, s) for k, v in cases.items() for i, s in enumerate(v.split())]
    g = Q.Groups(spark.createDataFrame(rows, "k string, o int, s string"), ["k"], "o", "s", model)
    got = {r["doc_key"]: (r["code"], r["message"]) for r in Q.sequence_findings(g).collect()}
    assert got == {"wrong order": ("cvc-complex-type.2.4.a", "Out of order: id comes before line"), "missing line": ("cvc-complex-type.2.4.b", "Missing here: line"),
                   "stray": ("cvc-complex-type.2.4.d", "Does not belong here: nope"), "too many": ("cvc-complex-type.2.4.d", "Does not belong here: note")}


def test_models():
    assert ambiguous(seq(elem("a", 0, 1), elem("a"))) == ["a"]
    assert ambiguous(seq(elem("a", 0, 1), elem("b"))) == []
    assert compile_model(elem("x", 1, 500_000)).size == 500_002
    m = compile_model(seq(elem("vehicle", 1, None, ["car", "van"], abstract=True), wildcard(0, None, excluding=["car"])))
    assert m.names[:-1] == ("car", "van") and m.completion[0] == ("car",)
    assert "vehicle" not in m.next_names(0)


def test_random_models_against_re(spark):
    rng = random.Random(11)

    def build(depth):
        if depth == 0 or rng.random() < 0.3:
            ch = rng.choice("abc")
            lo, hi = rng.choice([(1, 1), (0, 1), (0, None), (1, None), (1, 2), (0, 2)])
            return elem(ch, lo, hi), ch + {(1, 1): "", (0, 1): "?", (0, None): "*", (1, None): "+", (1, 2): "{1,2}", (0, 2): "{0,2}"}[lo, hi]
        parts = [build(depth - 1) for _ in range(rng.randint(1, 3))]
        lo, hi = rng.choice([(1, 1), (0, 1), (0, None), (1, 2)])
        mark = {(1, 1): "", (0, 1): "?", (0, None): "*", (1, 2): "{1,2}"}[lo, hi]
        if rng.random() < 0.5:
            return seq(*[p for p, _ in parts], lo=lo, hi=hi), f"(?:{''.join(t for _, t in parts)}){mark}"
        return choice(*[p for p, _ in parts], lo=lo, hi=hi), f"(?:{'|'.join(t for _, t in parts)}){mark}"

    for _ in range(300):
        model, text = build(3)
        m, rx = compile_model(model), re.compile(f"(?:{text})\\Z")
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))
            state = 0
            for ch in word:
                state = m.delta[state][m.names.index(ch) if ch in m.names else m.width - 1]
            assert (state in m.accepting) == bool(rx.match(word)), (text, word)
            assert m.completion[state] is not None or state == m.dead


def test_long_completions(spark):
    """Continuations of more than 40 symbols are found whole."""
    model = compile_model(seq(elem("head"), elem("x", 60, 80), choice(seq(elem("p"), elem("q")), elem("z"))))
    assert model.completion[0] == ("head", *["x"] * 60, "z")
    frame = spark.createDataFrame([(1, 1, "head"), (1, 2, "x"), (2, 1, "x"), (3, 1, "head"), *[(3, i, "x") for i in range(2, 62)], (3, 62, "z")], "k long, o long, s string")
    got = {r.k: r.missing for r in Q.missing_to_complete(Q.Groups(frame, ["k"], "o", "s", model)).collect()}
    assert got == {1: ["x"] * 59 + ["z"], 2: None, 3: []}
