"""Value spaces, facets, spec health and fixes."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import lexical as L
from plumbline.functions import text as X
from plumbline.functions import types as Y
from plumbline.functions.patterns import translate
from plumbline.operators import check as C

# type, text, valid: the corners of the value spaces
CASES = [
    ("date", "2026-02-30", False), ("date", "2024-02-29", True), ("date", "2023-02-29", False), ("date", "1900-02-29", False), ("date", "2000-02-29", True),
    ("date", "2026-01-01\n", True), ("date", "12026-02-28Z", True), ("date", "02026-02-28", False), ("date", "-0044-03-15", True), ("date", "2026-04-31", False),
    ("dateTime", "2026-01-01T24:00:00", True), ("dateTime", "2026-01-01T24:00:01", False), ("dateTime", "2026-01-01T10:00:00.123+14:00", True),
    ("dateTime", "2026-01-01T10:00:00+14:01", False), ("time", "23:59:59", True), ("time", "24:00:00.0", True), ("gMonthDay", "--02-29", True), ("gMonthDay", "--02-30", False),
    ("gMonth", "--13", False), ("gDay", "---31", True), ("gYear", "26", False), ("duration", "P1Y2M", True), ("duration", "P", False), ("duration", "P1YT", False),
    ("duration", "-PT0.5S", True), ("boolean", "1", True), ("boolean", "True", False), ("boolean", "yes", False), ("decimal", "1.", True), ("decimal", ".", False),
    ("decimal", "1e3", False), ("double", "1e3", True), ("double", "INF", True), ("double", "Infinity", False), ("float", "NaN", True),
    ("unsignedByte", "255", True), ("unsignedByte", "256", False), ("byte", "-128", True), ("byte", "-129", False), ("unsignedLong", "18446744073709551615", True),
    ("unsignedLong", "18446744073709551616", False), ("long", "9223372036854775808", False), ("integer", "99999999999999999999999999999999999999999999", True),
    ("long", "99999999999999999999999999999999999999999999", False), ("int", " 42 ", True), ("int", "4 2", False), ("positiveInteger", "0", False), ("positiveInteger", "007", True),
    ("integer", "1.0", True), ("integer", "1.5", False), ("hexBinary", "0aF", False), ("hexBinary", "0aFF", True), ("base64Binary", "AAAA", True), ("base64Binary", "AAA", False),
    ("base64Binary", "AA==", True), ("language", "en-GB", True), ("language", "toolonglang", False), ("Name", "a:b", True), ("NCName", "a:b", False), ("NMTOKEN", "1a", True),
    ("Name", "1a", False), ("IDREFS", "a b  c", True), ("IDREFS", "a 1b", False), ("dateTimeStamp", "2026-01-01T00:00:00", False), ("dateTimeStamp", "2026-01-01T00:00:00Z", True),
    ("yearMonthDuration", "P1Y2M", True), ("yearMonthDuration", "P1D", False), ("dayTimeDuration", "P1DT5M", True), ("dayTimeDuration", "P1M", False), ("QName", "a:b", True), ("QName", "a b", False),
]


def test_all_builtins_exist():
    assert len(Y.BUILTINS) == 49


def test_value_corners(spark):
    df = spark.createDataFrame([(i, t, v, ok) for i, (t, v, ok) in enumerate(CASES)], "i int, t string, v string, ok boolean")
    verdict = F.lit(None).cast("boolean")
    for name in {c[0] for c in CASES}:
        verdict = F.when(F.col("t") == name, Y.is_valid(F.col("v"), Y.builtin(name))).otherwise(verdict)
    wrong = [(r["t"], r["v"], r["ok"], r["got"]) for r in df.withColumn("got", verdict).collect() if r["ok"] != r["got"]]
    assert wrong == []


@pytest.mark.parametrize("kind,a,b,order", [
    ("duration", "P1M", "P30D", None), ("duration", "P1Y", "P12M", 0), ("duration", "P1M", "P2MT1S", -1), ("decimal", "1.50", "1.5", 0), ("decimal", "+007", "7.00", 0),
    ("decimal", "-0.00000000000000000000001", "0", -1), ("decimal", "9" * 44, "1" + "0" * 44, -1), ("double", "NaN", "1", None), ("double", "INF", "1e300", 1),
    ("dateTime", "2026-01-01T24:00:00", "2026-01-02T00:00:00Z", 0), ("time", "10:00:00+02:00", "08:00:00Z", 0), ("date", "12026-01-01", "9999-12-31", 1),
    ("gYear", "-0044", "0001", -1), ("string", "a", "b", None), ("string", "a", "a", 0), ("boolean", "1", "true", 0), ("hexBinary", "0aFF", "00", 1), ("date", "2026-02-30", "2026-01-01", None)])
def test_compare(spark, kind, a, b, order):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(L.compare(F.col("a"), F.col("b"), kind).alias("o")).first()
    assert row["o"] == order


def test_driver_and_column_instants_agree(spark):
    cases = [("date", "2024-02-29"), ("date", "-0001-01-01"), ("date", "12026-02-28+01:00"), ("dateTime", "2026-01-01T24:00:00"), ("dateTime", "1969-12-31T23:59:59.5-05:00"), ("gMonthDay", "--02-29"), ("gYear", "-0400")]
    for kind, text in cases:
        got = spark.createDataFrame([(text,)], "t string").select(L.instant(F.col("t"), kind).alias("s")).first()["s"]
        assert got == L.instant_of(text, kind), (kind, text)


def test_patterns(spark):
    assert translate("[a-z-[aeiou]]+") == r"\A(?:[a-z&&[^aeiou]]+)\z"
    assert translate("^a$") == r"\A(?:\^a\$)\z"
    assert translate("[") is None and translate("a{2") is None
    t = Y.derive(Y.builtin("string", pattern=["a+", "b+"]), "both", pattern="..")
    rows = spark.createDataFrame([("aa", True), ("bb", True), ("a", False), ("ab", False), ("aa\n", False)], "v string, ok boolean").select("ok", Y.is_valid(F.col("v"), t).alias("got")).collect()
    assert all(r["ok"] == r["got"] for r in rows)


def test_all_problems_are_reported(spark):
    t = Y.builtin("string", max_length=2, pattern="[0-9]+", enumeration=["12"])
    found = spark.createDataFrame([("abc",)], "v string").select(Y.problems(F.col("v"), t)["code"].alias("c")).first()["c"]
    assert found == ["cvc-maxLength-valid", "cvc-pattern-valid", "cvc-enumeration-valid"]


def test_lists_and_unions(spark):
    t = Y.list_of(Y.builtin("int"), "ints", min_length=2)
    df = spark.createDataFrame([("1",), ("1 2",), (" 1   x ",), ("",)], "v string")
    assert [r[0] for r in df.select(Y.problems(F.col("v"), t)["code"]).collect()] == [["cvc-minLength-valid"], [], ["cvc-datatype-valid.1.2.1"], ["cvc-minLength-valid"]]
    u = Y.union_of([Y.builtin("int"), Y.builtin("boolean")], "either", enumeration=["1", "true"])
    df = spark.createDataFrame([("1",), ("2",), ("true",), ("x",)], "v string")
    assert [r[0] for r in df.select(Y.is_valid(F.col("v"), u)).collect()] == [True, False, True, False]
    assert [r[0] for r in df.select(Y.matched_member(F.col("v"), u)).collect()] == ["int", "int", "boolean", None]


def test_spec_health():
    _, health = Y.compile_types({"a": {"base": "b"}, "b": {"base": "a"}, "c": {"base": "nope"}, "d": {"base": "string", "max_length": -1}, "e": {"base": "string", "max_length": 5, "fixed": ["max_length"]},
                                 "f": {"base": "e", "max_length": 3}, "g": {"base": "int", "max_inclusive": "99999999999"}, "h": {"base": "token", "white_space": "preserve"}})
    codes = {(n, c) for n, c, _ in health}
    assert {("a", "circular-type"), ("nope", "unresolved-reference"), ("d", "bad-facet-value"), ("f", "fixed-facet-overridden"), ("g", "facet-loosens-base"), ("h", "facet-loosens-base")} <= codes


ORDER = {"status": Y.builtin("string", enumeration=["Draft", "Issued", "Paid"]), "code": Y.builtin("token", pattern=r"[A-Z]{2}\d{4}"),
         "qty": Y.builtin("int", min_inclusive="1", max_inclusive="40"), "note": Y.builtin("string", max_length=5)}


def test_taxonomy_and_fixes(spark):
    df = spark.createDataFrame([(1, "draft", "ab1234", "500", "short"), (2, "Isued", "AB-1234", "12.0", "far too long"), (3, "Nothing", "AB1234", "x", "é𝄞abc")],
                               "id int, status string, code string, qty string, note string")
    found = {(r["row_key"], r["column"]): r for r in C.check_table(df, ORDER, ["id"], fixes=True).collect()}
    best = {k: [f["value"] for f in r["fixes"]] for k, r in found.items()}
    assert best[("1", "status")] == ["Draft"] and best[("2", "status")] == ["Issued"] and best[("3", "status")] == []
    assert best[("1", "code")] == ["AB1234"] and best[("2", "code")] == ["AB1234"]
    assert best[("1", "qty")] == ["1", "40"] and ("2", "qty") not in found and ("3", "note") not in found
    assert best[("2", "note")] == ["far t"]
    repaired, audit = C.apply_fixes(df, ORDER, ["id"])
    assert [r["status"] for r in repaired.orderBy("id").collect()] == ["Draft", "Isued", "Nothing"]
    again, audit = C.apply_fixes(df, ORDER, ["id"], speculative=True)
    left = C.check_table(again, ORDER, ["id"]).collect()
    assert {(r["row_key"], r["column"]) for r in left} == {("3", "status")}
    assert audit.count() == 7


def test_entities_and_names(spark):
    df = spark.createDataFrame([("a &lt;b&gt; &#65;&#x1F600; &foo; & &#x110000; &amp;lt;",)], "s string")
    assert df.select(X.decode_entities(F.col("s"))).first()[0] == "a <b> A\U0001F600 &foo; & &#x110000; &lt;"
    pairs = [("shipDate", "Ship date"), ("XMLDocument", "XML document"), ("AMOUNT", "Amount"), ("ship_date", "Ship date"), ("Already spaced", "Already spaced")]
    got = spark.createDataFrame(pairs, "a string, b string").select(X.humanise(F.col("a")).alias("g"), "b").collect()
    assert all(r["g"] == r["b"] for r in got)


def test_malformed_documents_are_told_apart(spark):
    bad = ["<a><b></a>", "<a></b>", "</a>", "<a>< </a>", "<a x=1/>", "<a x/>", "<!-- <a/>", "", "<a/><b/>", '<a x="1/>', "text", "<a/>tail"]
    good = ["<a/>", "<a>ok</a>", "<?xml version='1.0'?><!-- c --><a x='>'><b/><b/></a>", "<a><![CDATA[<b>]]></a>\n"]
    df = spark.createDataFrame([(s, False) for s in bad] + [(s, True) for s in good], "s string, ok boolean")
    rows = df.select("s", "ok", X.well_formed(F.col("s")).alias("got"), X.xpath_value(F.col("s"), "/a").alias("x")).collect()
    assert [r["s"] for r in rows if r["ok"] != r["got"]] == []
    assert all(r["x"] is None for r in rows if not r["ok"])


def test_long_durations(spark):
    pairs = [("P9999999999999D", "P1D", 1), ("-P9999999999999D", "P1D", -1), ("PT99999999999999999999S", "PT1S", 1), ("P99999999999999999Y", "P1Y", 1),
             ("P" + "9" * 40 + "D", "P1D", None), ("P1Y", "P" + "9" * 30 + "Y", None), ("P1D", "PT86400S", 0), ("P1M", "P30D", None), ("PT0.000001S", "PT0S", 1)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["c"] for r in df.select("i", L.compare(F.col("a"), F.col("b"), "duration").alias("c")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(pairs)}
