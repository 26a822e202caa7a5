"""Expressions evaluated apart for each row, and verdicts that lose no finding."""

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.functions.guarded import Scope, guarded
from plumbline.operators import findings as N
from plumbline.operators import keys as K
from plumbline.operators import record as R
from plumbline.operators import rules as B

ROWS = [(1, 10, 2, "7", "x", [1, 2]), (2, 10, 0, "seven", "cast (iron)", [5]), (3, None, 0, None, "a - b", []), (4, 2_000_000_000, 3, "12", "a / b", [0]), (5, 0, 5, "-1", None, None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, a int, b int, s string, note string, xs array<int>").cache()


@pytest.mark.parametrize("test, value, failed", [
    ("a / b > 2", {1: True, 4: True, 5: False}, {2}),
    ("a + a > 0", {1: True, 2: True, 5: False}, {4}),
    ("-a + b * -2 - 1 < 0", {1: True, 2: True, 5: True, 4: True}, set()),
    ("a * 2 / (b - 2) > 1", {2: False, 5: False}, {1, 4}),
    ("a div b > 1", {1: True, 4: True, 5: False}, {2}),
    ("a + s::int - 2147483640 > 0", {1: False, 5: False, 4: False}, {2}),
    ("a * a > 3000000000", {1: False, 2: False, 5: False}, {4}),
    ("cast(a * 5L as int) > 0", {1: True, 2: True, 5: False}, {4}),
    ("a * 9000000000000L < 0", {1: False, 2: False, 5: False}, {4}),
    ("not (100 div (b - 2) > 40)", {2: True, 3: True, 4: False, 5: True}, {1}),
    ("a % b = 0", {1: True, 4: False, 5: True}, {2}),
    ("cast(s as int) > 5", {1: True, 4: True, 5: False}, {2}),
    ("CAST(s AS INT) + s::int > 5", {1: True, 4: True, 5: False}, {2}),
    ("note <> 'cast (iron)'", {1: True, 2: False, 3: True, 4: True}, set()),
    ("note = 'a / b' or note = 'a - b'", {1: False, 2: False, 3: True, 4: True}, set()),
    ("b <> 0 and a / b > 2", {1: True, 2: False, 3: False, 4: True, 5: False}, set()),
    ("case when b = 0 then true else a / b > 2 end", {1: True, 2: True, 3: True, 4: True, 5: False}, set()),
    ("exists(xs, x -> 10 / x > 4) and b > 0", {1: True, 3: False, 2: False}, set()),
    ("element_at(xs, 1) > 0 -- a / b", {1: True, 2: True, 4: False}, set()),
    ("id between 1 + 1 and 2 * 2", {1: False, 2: True, 3: True, 4: True, 5: False}, set()),
    ("date '2020-01-01' + id > date '2020-01-03'", {1: False, 2: False, 3: True, 4: True, 5: True}, set()),
])
def test_rows_apart(df, test, value, failed):
    scope = Scope(df)
    got = df.select("id", scope.value(test).alias("v"), scope.failed(test).alias("f")).collect()
    assert {r["id"]: r["v"] for r in got if r["v"] is not None} == value
    assert {r["id"] for r in got if r["f"]} == failed


def test_texts_that_are_left_alone():
    for sql in ("(select max(a) / 0 from t)", "a > 'open", "(a / b"):
        assert guarded(sql).sql == sql
    assert guarded("f(a, b)").flags == [] and guarded("count(*)").sql == "count(*)"


def test_overflow_raises_nothing_inside(df):
    """A try_ function raises and catches an error for each row that overflows; whole numbers of known width go without."""
    scope = Scope(df)
    for sql in ("a + b", "a * 2", "a - 9L", "cast(a * 5L as int)"):
        assert "try_add" not in scope.guard(sql).sql and "try_multiply" not in scope.guard(sql).sql and "try_subtract" not in scope.guard(sql).sql
        assert scope.guard(sql).flags
    assert "try_cast(s as" not in scope.guard("cast(s as int)").sql
    assert "try_multiply" in scope.guard("a * 1.5D").sql


RULES = {"patterns": [{"id": "p", "rules": [{"id": "r", "context": "10 / b > 0 or b = 0", "assertions": [
    {"id": "rate", "test": "a / b > 2", "message": "rate {a / b}"}, {"id": "note", "kind": "report", "test": "note = 'cast (iron)'", "message": "iron"},
    {"id": "gone", "test": "missing > 0", "message": "m"}]}]}]}


def test_rules_keep_broken_rows_apart(df):
    rules = B.RuleSet.from_dict(RULES)
    found = {(r["row_key"], r["assertion_id"]): r["message"] for r in B.evaluate(df, rules, ["id"]).collect()}
    assert found == {("3", "rate"): "rate", ("5", "rate"): "rate 0.0", ("2", "note"): "iron"}  # NULL counts as false, a zero divisor as nothing
    stats = {r["assertion_ix"]: (r["passed"], r["failed"], r["broken_rows"]) for r in B.assertion_stats(df, rules).collect()}
    assert stats == {0: (2, 2, 1), 1: (4, 1, 0), 2: (0, 0, 5)}
    assert {r["message"] for r in B.broken_in_rows(B.assertion_stats(df, rules)).collect()} == {"cannot be evaluated on 1 rows", "cannot be evaluated on 5 rows"}


def test_rows_that_share_a_key(spark, tmp_path):
    """Messages and hints of each line that the key of a finding names, as the SQL of B6 and B7 has them."""
    lines = spark.createDataFrame([(1, 2, 3, 46.0, 900.0, 0.0, 0.02, "R", "F"), (1, 2, 3, 7.0, 900.0, 0.0, 0.02, "R", "F"), (1, 3, 3, 50.0, 900.0, 0.0, 0.02, "R", "F")],
                                  "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    catalog.load_all()
    for name, n in (("B6_render_message", 3), ("B7_diagnostics", 3)):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        want = sorted(con.sql(f"select {', '.join(columns)} from ({catalog.SQL[name]})").fetchall())
        assert sorted(map(tuple, got.select(*columns).collect())) == want and len(want) == n


def test_record_lookup_and_group_rules(df, spark):
    found = R.assert_record(df, "a / b > 2", ["id"], doc="id").collect()
    assert sorted((r["code"], r["doc_key"]) for r in found if r["doc_key"]) == [("cvc-assertion-valid", "3"), ("cvc-assertion-valid", "5")]
    assert [r["message"] for r in found if not r["doc_key"]] == ["the rule cannot be evaluated on 1 rows: a / b > 2"]
    assert R.select_type(df, [("a / b > 2", "high")], "low").where("type = 'high'").count() == 2
    side = spark.createDataFrame([(0, 0), (2, 4), (3, 1)], "b int, limit int")
    got = K.lookup_rule(df, {"side": side}, "side", {"b": "b"}, "a / side.limit > 3", ["id"], "m", doc="id").collect()
    assert sorted(r["doc_key"] for r in got) == ["1", "3", "5"]  # 2 divides by zero, 4 holds
    children = spark.createDataFrame([(1, 0), (2, 4)], "id int, v int")
    got = B.group_assert(df, children, ["id"], {"t": F.sum("v")}, "a / t > 5", "m", doc="id").collect()
    assert sorted(r["doc_key"] for r in got) == ["2", "3", "4", "5"]


def test_verdict_loses_no_finding(df, spark):
    docs = spark.createDataFrame([("a|b", None), ("c", "en"), ("d", None)], "doc string, lang string")
    found = R.required_fields(docs, ["lang"], ["lang"], doc="doc")
    assert {r["doc"]: r["valid"] for r in N.verdict(found, docs, "doc").collect()} == {"a|b": False, "c": True, "d": False}
    twice = docs.unionByName(docs.where("doc = 'c'"))
    assert {r["doc_key"] for r in K.key(twice, ["doc"], doc="doc").collect()} == {"c"}
    with pytest.raises(PySparkException, match="names no document"):
        N.verdict(R.required_fields(docs, ["lang"], ["doc"]), docs, "doc").collect()
    other = N.union_findings(found.where("false"), docs.limit(1).select(*N.finding(source="schema-health", severity="error", code="bad-facet-value")))
    assert all(r["valid"] for r in N.verdict(other, docs, "doc").collect())
