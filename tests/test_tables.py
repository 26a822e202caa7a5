"""Records, keys, skew, rules, profiles, documents and streams on small fixtures."""

import random
import time

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import types as Y
from plumbline.functions.model import compile_model, elem, seq
from plumbline.operators import check as C
from plumbline.operators import graph as G
from plumbline.operators import keys as K
from plumbline.operators import profile as P
from plumbline.operators import record as R
from plumbline.operators import rules as B
from plumbline.operators import shred as S
from plumbline.operators import synth as M
from plumbline.plans import ordered as O
from plumbline.plans.skew import skew_join, top_n_per_group
from plumbline.sources import documents as D
from plumbline.streaming import monitor as V


def rows(df):
    return sorted(map(lambda r: str(tuple(r)), df.collect()))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key, and some have none."""
    rng = random.Random(5)
    data = [(i, 7 if i % 3 == 0 else (None if i % 11 == 0 else rng.randint(0, 40)), i * 3 + rng.randint(0, 2), rng.choice(["x", "y", None])) for i in range(3000)]
    return spark.createDataFrame(data, "id int, k int, o int, v string").cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, skewed, how):
    side = spark.createDataFrame([(k, f"s{k}") for k in range(0, 41, 2)] + [(7, "seven")], "k int, s string")
    assert rows(skew_join(skewed, side, ["k"], how, k=3, salts=8, salted=True)) == rows(skewed.join(side, ["k"], how))


def test_ordered_operators_on_cut_groups(skewed):
    df = skewed  # rows without a key are one more group
    w = W.partitionBy("k").orderBy("o")
    cut, flag = O.with_chunks(df, ["k"], "o", 50)
    assert flag and cut.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] < 400
    assert rows(O.row_numbers(df, ["k"], "o", "n", 50)) == rows(df.withColumn("n", F.row_number().over(w).cast("long")))
    assert rows(O.neighbours(df, ["k"], "o", "v", "p", "f", 50)) == rows(df.withColumn("p", F.lag("v").over(w)).withColumn("f", F.lead("v").over(w)))
    last = F.last("v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    assert rows(O.running_last(df, ["k"], "o", "v", "l", 50)) == rows(df.withColumn("l", last))


def test_limit_and_positions(skewed):
    got = top_n_per_group(skewed, ["k"], [F.col("o"), F.col("id")], 5, "rank", salts=4)
    want = skewed.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy("o", "id"))).where("rank <= 5")
    assert rows(got) == rows(want)
    placed = O.positions(skewed, ["o", "id"]).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(1, 3001))
    assert [(r["o"], r["id"]) for r in placed] == sorted((r["o"], r["id"]) for r in placed)


def test_keys_with_nulls_and_hot_values(spark, skewed):
    assert K.keyref(skewed, spark.createDataFrame([(i,) for i in range(41) if i != 7], "k int"), {"k": "k"}, ["id"]).count() == skewed.where("k = 7").count() > 900
    found = K.key(skewed.where("id < 30"), ["k"], ["id"])
    assert found.where("code = 'cvc-identity-constraint.4.2.1'").count() == skewed.where("id < 30 and k is null").count()


def test_closure_with_cycles_and_abstract_heads(spark):
    edges = spark.createDataFrame([("vehicle", "car"), ("car", "van"), ("van", "vehicle"), ("car", "taxi")], "head string, member string")
    got = {(r["head"], r["member"]): r["depth"] for r in G.closure(edges).collect()}
    assert got[("vehicle", "taxi")] == 2 and got[("van", "car")] == 2 and ("car", "car") not in got
    abstract = spark.createDataFrame([("car",)], "name string")
    assert {r["member"] for r in G.closure(edges, abstract=abstract).where("head = 'vehicle'").collect()} == {"van", "taxi"}


def test_unknown_side_table_is_loud(spark, skewed):
    with pytest.raises(KeyError):
        K.lookup_rule(skewed, {}, "codes", {"k": "k"}, "codes.k > 0", ["id"], "m")


def test_broken_assertion_is_not_a_failed_one(spark, skewed):
    one = R.assert_record(skewed, "no_such_column > 0", ["id"]).collect()
    assert [(r["severity"], r["code"]) for r in one] == [("warning", "schema-assert-broken")]
    assert R.assert_record(skewed, "v = 'x'", ["id"]).count() == skewed.where("v is null or v <> 'x'").count()


LINES = [(1, 2, 5.0), (2, 1, 5.0), (3, 0, 1.0)]


def rule_frame(spark):
    return spark.createDataFrame(LINES, "ordinal int, qty int, price double")


def run(df, *patterns, **kw):
    spec = {"patterns": [{"id": f"p{i}", "rules": p} for i, p in enumerate(patterns)], **kw}
    return B.evaluate(df, B.RuleSet.from_dict(spec), ["ordinal"], order="ordinal")


def test_rule_semantics(spark):
    df = rule_frame(spark)
    ok = {"test": "qty > 0", "message": "bad {qty}"}
    assert [r["ordinal"] for r in run(df, [{"context": "true", "assertions": [ok]}]).collect()] == [3]
    assert [r["message"] for r in run(df, [{"context": "true", "assertions": [{"kind": "report", "test": "qty = 0", "message": "zero {qty}"}]}]).collect()] == ["zero 0"]
    never = [{"test": "false", "message": "m"}]
    first = [{"context": "qty = 0", "id": "zero", "assertions": never}, {"context": "true", "id": "rest", "assertions": never}]
    assert sorted(r["rule_id"] for r in run(df, first).collect()) == ["rest", "rest", "zero"]
    assert run(df, first[1:], first[1:]).count() == 6
    stats = B.rule_stats(df, B.RuleSet.from_dict({"patterns": [{"id": "p", "rules": [
        {"id": "all", "context": "true", "assertions": []}, {"id": "late", "context": "price > 4", "assertions": []}, {"id": "dead", "context": "qty > 99", "assertions": []}]}]}))
    assert [(r["rule_id"], r["shadowed_by"]) for r in B.shadowed_rules(stats).collect()] == [("late", "all")]
    assert [r["rule_id"] for r in B.dead_rules(stats).collect()] == ["dead"]


def test_null_makes_an_assert_fire(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "ordinal int, qty int")
    assert [r["ordinal"] for r in run(df, [{"context": "true", "assertions": [{"test": "qty > 0", "message": "m"}]}]).collect()] == [1]
    assert run(df, [{"context": "true", "assertions": [{"kind": "report", "test": "qty > 9", "message": "m"}]}]).count() == 0


def test_bad_cast_does_not_fail_the_job(spark):
    df = spark.createDataFrame([(1, "x"), (2, "5")], "ordinal int, qty string")
    cast, tried = ([{"context": "true", "assertions": [{"test": f"{c}(qty AS INT) > 0", "message": "m"}]}] for c in ("CAST", "TRY_CAST"))
    assert run(df, cast).count() == 0  # a row that cannot be evaluated neither passes nor fails
    stats = B.assertion_stats(df, B.RuleSet.from_dict({"patterns": [{"id": "p", "rules": cast}]})).first()
    assert (stats["passed"], stats["failed"], stats["broken_rows"]) == (1, 0, 1)
    assert [r["ordinal"] for r in run(df, tried).collect()] == [1]  # asked for as NULL, which counts as false


def test_templates_and_phases():
    assert B.fill_in("$itemTotal > $item", {"item": "a", "itemTotal": "b"}) == "b > a"
    rs = B.RuleSet.from_dict({"patterns": [{"id": "a"}, {"id": "b"}], "phases": {"one": ["a"]}, "default_phase": "one"})
    assert [p.id for p in rs.phase().patterns] == ["a"] and len(rs.phase("#ALL").patterns) == 2
    with pytest.raises(KeyError):
        rs.phase("nowhere")


def test_invoice_fails_exactly_one_rule(spark):
    invoice = spark.createDataFrame([("I1", 120.0), ("I2", 140.0)], "number string, total double")
    lines = spark.createDataFrame([("I1", 100.0), ("I1", 40.0), ("I2", 140.0)], "number string, amount double")
    found = B.group_assert(invoice, lines, ["number"], {"s": F.sum("amount")}, "total = s", "total {total} against {s}")
    assert [(r["row_key"], r["message"]) for r in found.collect()] == [("I1", "total 120.0 against 140.0")]


def test_inferred_spec_accepts_its_source(spark):
    df = spark.createDataFrame([(i, f"2026-01-{i:02d}", ["on", "off"][i % 2], None if i == 3 else "free text", f"{i}.50") for i in range(1, 9)], "id int, day string, state string, note string, price string")
    cols = df.columns
    made = P.render_spec(df, cols)
    spec = P.spec_from_rows(made)
    assert {c: s["type"].name for c, s in spec.items()} == {"id": "integer", "day": "date", "state": "string", "note": "string", "price": "decimal"}
    assert spec["state"]["type"].enumeration == ("off", "on") and not spec["note"]["required"]
    assert C.check_table(df, {c: s["type"] for c, s in spec.items()}, ["id"]).count() == 0
    assert "day DATE NOT NULL" in P.ddl(made)


def test_synthetic_rows_pass_their_spec(spark):
    spec = {name: {"type": t, "required": True} for name, t in Y.BUILTINS.items() if t.primitive not in ("QName", "NOTATION") and t.variety == "atomic"
            and name not in ("Name", "NCName", "ID", "IDREF", "ENTITY", "NMTOKEN", "language", "dateTimeStamp", "yearMonthDuration", "dayTimeDuration")}
    made = M.synthesise(spark.range(3), "id", spec)
    assert C.check_table(made, {c: s["type"] for c, s in spec.items()}, ["id"]).collect() == []
    nested = M.synthesise_nested(spark.range(2), "id", {"order": {"fields": {"ref": {"type": Y.builtin("token", min_length=2), "required": True}}, "children": {"line": (2, None), "order": (1, 1)}}, "line": {"fields": {"qty": {"type": Y.builtin("positiveInteger"), "required": True}}}}, "order")
    line = [{"qty": "1"}, {"qty": "1"}]
    assert nested.first()["order"].asDict(recursive=True) == {"ref": "xx", "line": line, "order": [{"ref": "xx", "line": line}]}


def test_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("007", "1.50", "a < b & c"), ("8", None, "x")], "id string, price string, note string")
    path = str(tmp_path / "docs")
    D.write_documents(df, path, "orders", "order")
    back = D.read_documents(spark, path, "order", "id INT, price DOUBLE, note STRING")
    assert rows(back.select("id", "price", "note")) == rows(df)
    assert [f.dataType.simpleString() for f in back.schema.fields][:3] == ["string"] * 3


def test_shred_and_table(spark):
    df = spark.createDataFrame([(1, ("o1", [("A", 2), ("B", None)]))], "id int, order struct<_ref:string,line:array<struct<sku:string,qty:int>>>")
    nodes = S.shred(df, "order", ["id"])
    got = [(r["path"], r["ordinal"], r["value"]) for r in nodes.orderBy("node_ix").collect()]
    assert got == [("/order", 1, None), ("/order/line", 1, None), ("/order/line/sku", 1, "A"), ("/order/line/qty", 1, "2"), ("/order/line", 2, None), ("/order/line/sku", 1, "B")]
    assert [tuple(r) for r in S.attributes(nodes, ["id"]).select("attribute", "value").collect()] == [("ref", "o1")]
    cells = nodes.where("depth = 3").withColumn("row", F.element_at("position", 3))
    assert [tuple(r) for r in S.repeated_to_table(cells, ["row"], "name", "value").orderBy("row").collect()] == [(1, "2", "A"), (2, None, "B")]


def test_text_parts_of_a_large_parent(spark):
    df = spark.createDataFrame([(1, i, chr(97 + i % 26)) for i in range(200)], "k int, o int, t string")
    parts = S.text_of(df, ["k"], "o", "t", chunk_rows=30).orderBy("part").collect()
    assert len(parts) > 3 and "".join(p["text"] for p in parts) == "".join(chr(97 + i % 26) for i in range(200))


def test_guarded_check_keeps_quiet_while_the_spec_is_broken(spark):
    def build(spec):
        t = Y.builtin(spec["type"])
        return lambda df: C.check_column(df, "v", t, ["id"])
    check = V.GuardedCheck(build)
    df = spark.createDataFrame([(1, "x")], "id int, v string")
    assert check.update({"type": "int"}) and check(df).count() == 1
    assert not check.update({"type": "nope"}) and check(df).count() == 0 and check.error


def test_monitor_reports_violations_and_incomplete_keys(spark, tmp_path):
    model = compile_model(seq(elem("open"), elem("work", 0, None), elem("close")))
    data = [("a", 1, "open"), ("a", 2, "close"), ("b", 1, "open"), ("b", 2, "work"), ("c", 1, "work")]
    src = str(tmp_path / "in")
    spark.createDataFrame(data, "k string, t int, s string").selectExpr("k", "timestamp_seconds(t) as ts", "s").write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp, s string").parquet(src)
    seen = []
    def sink(batch, _):
        seen.extend((r["key"], r["status"]) for r in batch.collect())
    query = V.sequence_monitor(stream, "k", "ts", "s", model, timeout_ms=500).writeStream.outputMode("update").foreachBatch(sink) \
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and ("b", "incomplete") not in seen:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(set(seen)) == [("b", "incomplete"), ("c", "violation")]


def test_profile_values(spark):
    """All values of a name, more than the 64 of the profile's list."""
    from plumbline.operators import profile as P

    frame = spark.range(500).selectExpr("concat(' v', id % 200) as a", "case when id < 5 then ' ' else 'b' end as b")
    got = {(r.name, r.value): r.occurrences for r in P.profile_values(P.as_nodes(frame, ["a", "b"])).collect()}
    assert got == {**{("a", f"v{i}"): 3 if i < 100 else 2 for i in range(200)}, ("b", "b"): 495}
