"""Closures in few rounds and the health of specs held as rows, against direct versions."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from plumbline.functions.types import BUILTINS, compile_types, derive
from plumbline.operators import graph as G
from plumbline.operators import spec_rows as H
from plumbline.plans.skew import planned_bytes


def reach(edges, sources):
    """(source, node): least number of edges, by breadth-first search."""
    after = {}
    for a, b in edges:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
    out = {}
    for s in sources:
        depth, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for y in after.get(x, ()):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    queue.append(y)
        out |= {(s, n): d for n, d in depth.items() if n != s}
    return out


@pytest.fixture
def rounds(monkeypatch):
    made, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: made.append(1) or cut(df))
    return made


def test_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(None, 3), (4, None)]
    edges += [(100 + i, 101 + i) for i in range(20)] + [(120, 5), (7, 100)] + [(200 + i, 200 + (i + 1) % 6) for i in range(6)]  # a long run, a ring
    df = spark.createDataFrame(edges, "head int, member int").cache()
    nodes = {x for e in edges for x in e if x is not None}
    got = {(r["head"], r["member"]): r["depth"] for r in G.closure(df).collect()}
    assert got == reach(edges, nodes)
    sources = [7, 110, 203, 3, 999]
    starts = spark.createDataFrame([(s,) for s in sources + [7, None]], "s int")
    got = {(r["head"], r["member"]): r["depth"] for r in G.closure(df, starts=starts).collect()}
    assert got == reach(edges, sources)
    gone = spark.createDataFrame([(5,), (100,)], "n int")
    assert {r["member"] for r in G.closure(df, starts=starts, abstract=gone).collect()} == {b for _, b in reach(edges, sources)} - {5, 100}
    assert {r["a"] for r in G.all_pairs(df, "head", "member").where("a = b").collect()} >= set(range(200, 206))
    assert G.closure(df.limit(0)).count() == 0 and G.closure(df.limit(0), starts=starts).count() == 0


def test_chain_of_4096(spark, rounds):
    """All pairs of a chain in rounds that double, and one source in rounds that cross whole runs."""
    n = 4096
    chain = spark.range(n - 1).select(F.col("id").alias("head"), (F.col("id") + 1).alias("member"))
    out = G.closure(chain)
    got = out.agg(F.count("*"), F.sum("depth"), F.sum((F.col("member") - F.col("head") != F.col("depth")).cast("int"))).first()
    assert tuple(got) == (n * (n - 1) // 2, sum(d * (n - d) for d in range(1, n)), 0) and len(rounds) <= 16
    rounds.clear()
    out = G.closure(chain, starts=spark.createDataFrame([(5,)], "s long"))
    assert {(r["member"], r["depth"]) for r in out.collect()} == {(m, m - 5) for m in range(6, n)}
    assert len(rounds) <= 24  # twelve doublings of pointers, and two rounds over the bridged graph


def test_spec_health_as_compiled(spark):
    rng = random.Random(8)
    facets = {"max_length": lambda: rng.choice([3, 5, 9, 20, "x"]), "min_length": lambda: rng.choice([0, 2, 4, 30]), "max_inclusive": lambda: rng.choice(["5", "9.5", "abc"]),
              "white_space": lambda: rng.choice(["collapse", "replace", "preserve", "none"]), "pattern": lambda: rng.choice(["[a-z]+", "[z-a"]), "odd": lambda: 1}
    specs = {}
    for i in range(60):
        base = rng.choice([f"t{rng.randrange(i)}"] * 6 + ["string", "token", "decimal", "integer", "nowhere"] if i else ["string"])
        specs[f"t{i}"] = {"base": base} | {f: make() for f, make in facets.items() if rng.random() < 0.25}
    _, health = compile_types(specs)
    types = spark.createDataFrame([(n, s["base"]) for n, s in specs.items()], "name string, base string")
    rows = spark.createDataFrame([(n, f, str(v), False) for n, s in specs.items() for f, v in s.items() if f != "base"], "name string, facet string, value string, fixed boolean")
    got = {(r["rule_id"], r["code"]) for r in H.type_health(types, rows).collect()}
    assert got == {(name, code) for name, code, _ in health}
    assert {c for _, c in got} >= {"facet-loosens-base", "bad-facet-value", "unresolved-reference", "bad-pattern"}
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "string"), ("d", "token")], "name string, base string")
    got = {(r["rule_id"], r["code"]) for r in H.type_health(ring, rows.limit(0)).collect()}
    assert got == {("a", "circular-type"), ("b", "circular-type"), ("d", "duplicate-definition")}
    fixed = spark.createDataFrame([("a", "max_length", "5", True), ("b", "max_length", "4", False), ("c", "max_length", "9", False)], "name string, facet string, value string, fixed boolean")
    tree = spark.createDataFrame([("a", "string"), ("b", "a"), ("c", "b")], "name string, base string")
    assert {(r["rule_id"], r["code"]) for r in H.type_health(tree, fixed).collect()} == {("b", "fixed-facet-overridden"), ("c", "fixed-facet-overridden")}


def test_bounds_are_read_when_a_type_is_made():
    for base, bad, good in (("double", "abc", "1e3"), ("date", "soon", "2020-01-31"), ("decimal", "1e3", "-1.5"), ("duration", "P", "P1Y2M")):
        assert [c for _, c, _ in derive(BUILTINS[base], "t", max_inclusive=bad).health] == ["bad-facet-value"]
        assert derive(BUILTINS[base], "t", max_inclusive=good).health == ()


def test_estimates_stay_small(spark):
    """The planner's size of a closure does not grow with its rounds: as a product of joins its digits doubled with each."""
    chain = spark.range(100).selectExpr("id as head", "id + 1 as member")
    assert planned_bytes(G.closure(chain, starts=spark.createDataFrame([(0,)], "s long"))) < 1 << 60
    assert planned_bytes(G.closure(chain)) < 1 << 60
