"""Fix candidates, repairs, synthetic rows and their review."""

from pyspark.sql import functions as F

from plumbline.catalog import base, query, table, with_base
from plumbline.catalog.sequence import TALK
from plumbline.checkers import RuleChecker, TypeChecker, register_function, run_checkers
from plumbline.functions import types as Y
from plumbline.functions.model import compile_model
from plumbline.operators import check as C
from plumbline.operators import sequence as Q
from plumbline.operators import synth as G
from plumbline.operators import vocabulary as V
from plumbline.operators.record import required_fields
from plumbline.operators.rules import RuleSet

STATUS = Y.builtin("string", enumeration=["O", "F", "P"])


def values_of(df, col, t, sample=None):
    found = C.fix_candidates(F.col(col), t, sample)
    return F.array_join(F.transform(found, lambda f: F.concat(f["value"], F.when(f["speculative"], "?").otherwise("!"))), ",")


@query("C1_fix_candidates", with_base("order_text") + """
select o_orderkey, status, case when status in ('o', 'f', 'p') then upper(status) || '!' when ends_with(status, 'x') then left(status, 1) || '?' else case status when 'O' then 'F?' else '' end end as fixes
from order_text where status not in ('O', 'F', 'P')""")
def candidates(spark, sf):
    df = base(spark, sf, "order_text").where(~Y.is_valid(F.col("status"), STATUS))
    return df.select("o_orderkey", "status", values_of(df, "status", STATUS).alias("fixes"))


@query("C2_trim", with_base("order_text") + "select o_orderkey, trim(priority, ' ') || '!' as fixes from order_text where priority <> trim(priority, ' ')")
def trim(spark, sf):
    t = Y.builtin("string", pattern=r"\S.*\S")
    df = base(spark, sf, "order_text").where(~Y.is_valid(F.col("priority"), t))
    first = F.get(C.fix_candidates(F.col("priority"), t), F.lit(0))
    return df.select("o_orderkey", F.concat(first["value"], F.when(first["speculative"], "?").otherwise("!")).alias("fixes"))


@query("C3_enumeration_fixes", with_base("event_names") + """
, d as (select unnest(['click', 'view', 'error', 'purchase', 'signup']) as o, unnest([0, 1, 2, 3, 4]) as i),
n as (select distinct name from event_names where name not in (select o from d)),
b as (select name, arg_min(o, levenshtein(lower(name), o) * 10 + i) as o, min(levenshtein(lower(name), o)) as dist from n, d group by name)
select event_id, name, case when dist = 0 then o || '!' when dist <= 3 then o || '?' else '' end as fixes from event_names join b using (name)""")
def enumeration(spark, sf):
    t = Y.builtin("string", enumeration=["click", "view", "error", "purchase", "signup"])
    df = base(spark, sf, "event_names").where(~Y.is_valid(F.col("name"), t))
    return df.select("event_id", "name", values_of(df, "name", t).alias("fixes"))


@query("C3b_vocabulary_fixes", with_base("part_names") + """
, w as (select distinct p_name as word from part), n as (select distinct name from part_names where name is not null and name not in (select word from w)),
r as (select name, word, levenshtein(lower(trim(name, ' ')), lower(word)) as edits from n, w),
b as (select name, min(edits) as edits, arg_min(word, (edits, word)) as word from r where edits <= 3 group by name)
select p_partkey, name, coalesce(word || case when edits = 0 then '!' else '?' end, '') as fixes from part_names join n using (name) left join b using (name)""")
def listed(spark, sf):
    """Nearest listed names for the parts whose name is not listed."""
    words = V.vocabulary(table(spark, sf, "part"), "p_name")
    df = base(spark, sf, "part_names")
    found = V.check_vocabulary(df, "name", words, ["p_partkey"], fixes=True)
    first = F.get("fixes", F.lit(0))
    shown = F.coalesce(F.concat(first["value"], F.when(first["speculative"], "?").otherwise("!")), F.lit(""))
    return df.join(found.select(F.col("row_key").cast("long").alias("p_partkey"), shown.alias("fixes")), "p_partkey")


@query("C4_pattern_fixes", with_base("part_text") + """
select p_partkey, brand, case when starts_with(brand, 'b') then upper(brand) || '?' when contains(brand, '-') then replace(brand, '-', '') || '?' end || case when brand = 'Brand-#1' then '' else ',Brand#1?' end as fixes
from part_text where starts_with(brand, 'b') or contains(brand, '-')""")
def pattern(spark, sf):
    t = Y.builtin("string", pattern=[r"B[A-Za-z]*#\d+"])
    df = base(spark, sf, "part_text").where(~Y.is_valid(F.col("brand"), t))
    return df.select("p_partkey", "brand", values_of(df, "brand", t, "Brand#1").alias("fixes"))


@query("C5_truncate", r"""
select doc_id, md5(left(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), 100)) as digest from documents where length(text) > 100""")
def truncate(spark, sf):
    t = Y.builtin("string", max_length=100)
    df = table(spark, sf, "documents").where(~Y.is_valid(F.col("text"), t))
    return df.select("doc_id", F.md5(C.best_fix(F.col("text"), t, speculative=True)["value"]).alias("digest"))


@query("C6_clamp", with_base("line_text") + """
select l_orderkey, l_linenumber, l_partkey, case when cast(qty as decimal(10,2)) < 5 then '5' else '5?45' end as fixes from line_text where not cast(qty as decimal(10,2)) between 5 and 45""")
def clamp(spark, sf):
    t = Y.builtin("decimal", min_inclusive="5", max_inclusive="45")
    df = base(spark, sf, "line_text").where(~Y.is_valid(F.col("qty"), t))
    values = F.transform(C.fix_candidates(F.col("qty"), t), lambda f: f["value"])
    low = F.col("qty").cast("decimal(10,2)") < 5
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.when(low, F.get(values, F.lit(0))).otherwise(F.concat_ws("?", F.filter(values, lambda v: v.isin("5", "45")))).alias("fixes"))


@query("C7_drop_decimal_part", with_base("line_text") + """
select l_orderkey, l_linenumber, l_partkey, replace(qty, '.0', '') as fixed from line_text where ends_with(qty, '.0')""")
def whole(spark, sf):
    t = Y.builtin("string", pattern=r"-?\d+")
    number = Y.derive(Y.BUILTINS["decimal"], "plain", pattern=r"-?\d+")
    df = base(spark, sf, "line_text").where(~Y.is_valid(F.col("qty"), t))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.filter(C.fix_candidates(F.col("qty"), number), lambda f: ~f["speculative"])[0]["value"].alias("fixed"))


@query("C8_apply_fixes", with_base("order_text") + """
select o_orderkey, case when status in ('o', 'f', 'p') then upper(status) else status end as status, total, status in ('o', 'f', 'p') as logged from order_text""")
def apply(spark, sf):
    spec = {"status": STATUS, "total": Y.builtin("decimal", max_inclusive="300000")}
    repaired, audit = C.apply_fixes(base(spark, sf, "order_text"), spec, ["o_orderkey"])
    logged = audit.select("o_orderkey", F.lit(True).alias("logged"))
    return repaired.select("o_orderkey", "status", "total").join(logged, "o_orderkey", "left").withColumn("logged", F.coalesce("logged", F.lit(False)))


@query("C9_rename_fields", """
select event_id, coalesce(case when event_id % 3 = 0 then v when event_id % 3 = 1 then v end, '-') as k, event_type as kind
from (select event_id, event_type, regexp_extract(props, '[0-9]+') as v from events)""")
def rename(spark, sf):
    """A misspelt column and misspelt map keys; key "zzzzzz" is too far from any and is removed."""
    df = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kindd"), F.create_map(
        F.when(F.col("event_id") % 3 == 0, "count").when(F.col("event_id") % 3 == 1, "Coun").otherwise("zzzzzz"), F.regexp_extract("props", "[0-9]+", 0)).alias("m"))
    df = C.rename_fields(df, ["event_id", "kind", "m"])
    return df.select("event_id", F.coalesce(F.try_element_at(C.rename_keys(F.col("m"), ["count", "other"]), F.lit("count")), F.lit("-")).alias("k"), "kind")


@query("C10_fill_missing_children", """
with s as (select conv_id, max(turn) as last, string_agg(left(role, 1), '' order by turn) as s from conversations group by conv_id)
select conv_id, turn, role, false as added from conversations union all select conv_id, last + 1, 'assistant', true from s where regexp_full_match(s, 's?(ua)*u')""")
def fill(spark, sf):
    g = Q.Groups(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", compile_model(TALK))
    return Q.fill_missing_children(g, {"text": F.lit("")}).select("conv_id", "turn", "role", "added")


ORDER_SPEC = {"status": {"type": STATUS, "required": True}, "total": {"type": Y.builtin("decimal", min_inclusive="10.50"), "required": True},
              "day": {"type": Y.builtin("date"), "required": True}, "code": {"type": Y.builtin("token", pattern=r"[A-Z]{2}\d{4}"), "required": True, "sample": "AB1234"},
              "note": {"type": Y.builtin("string", max_length=5)}, "version": {"type": Y.builtin("token"), "required": True, "fixed": "2.0"}}


@query("G1_synthesise", """
select o_orderkey, ['O', 'F', 'P'][cast(o_orderkey % 3 + 1 as integer)] as status, '10.50' as total, '2026-01-01' as day, 'AB1234' as code, cast(null as varchar) as note, '2.0' as version, 0 as problems from orders""")
def synthesise(spark, sf):
    rows = G.synthesise(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", ORDER_SPEC)
    bad = None
    for c, s in ORDER_SPEC.items():
        one = F.size(Y.problems(F.col(c), s["type"]))
        bad = one if bad is None else bad + one
    return rows.withColumn("problems", bad)


@query("G1b_synthesise_groups", "select c_custkey, cast(p as integer) as ordinal, role as symbol from customer, (values (0, 'user'), (1, 'assistant')) v(p, role)")
def groups(spark, sf):
    return G.synthesise_groups(table(spark, sf, "customer").select("c_custkey"), "c_custkey", compile_model(TALK))


@query("G4_pending_review", """
select o_orderkey, field, value from (select o_orderkey, 'status' as field, case when o_orderkey % 4 = 0 then 'O' else o_orderstatus end as value, ['O', 'F', 'P'][cast(o_orderkey % 3 + 1 as integer)] as made from orders
  union all select o_orderkey, 'total', cast(cast(o_totalprice as decimal(18,2)) as varchar), '10.50' from orders) where value = made""")
def pending(spark, sf):
    made = G.synthesise(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", ORDER_SPEC)
    cells = made.select("o_orderkey", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("status", "total")])))
    now = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "O").otherwise(F.col("o_orderstatus")).alias("status"),
                                            F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    return G.pending_review(now, cells, ["o_orderkey"]).select("o_orderkey", "field", "value")


@query("F1_registered_function", "select cast(l_orderkey as varchar) || '|' || l_linenumber as row_key from lineitem where not l_extendedprice * (1 - l_discount) >= 1000")
def function(spark, sf):
    register_function(spark, "net_price", "p DOUBLE, d DOUBLE", "DOUBLE", "p * (1 - d)")
    rules = RuleSet.from_dict({"patterns": [{"id": "p", "rules": [{"context": "true", "assertions": [{"test": "net_price(l_extendedprice, l_discount) >= 1000", "message": "small"}]}]}]})
    return table(spark, sf, "lineitem").transform(RuleChecker(rules, ["l_orderkey", "l_linenumber"])).select("row_key")


class RequiredChecker:
    source = "schema"

    def __init__(self, cols, key):
        self.cols, self.key = cols, key

    def __call__(self, df):
        return required_fields(df, self.cols, self.key)


@query("F2_pluggable_checkers", with_base("docs_gaps") + """
select code, count(*) as findings from (select 'cvc-complex-type.4' as code from docs_gaps where lang is null
  union all select 'cvc-enumeration-valid' from docs_gaps where lang not in ('en', 'de') union all select 'assert' from docs_gaps where not coalesce(n_chars < 2000, false)) group by code""")
def checkers(spark, sf):
    rules = RuleSet.from_dict({"patterns": [{"id": "p", "rules": [{"context": "true", "assertions": [{"test": "n_chars < 2000", "message": "long"}]}]}]})
    found = run_checkers(base(spark, sf, "docs_gaps"), [TypeChecker({"lang": Y.builtin("string", enumeration=["en", "de"])}, ["doc_id"]), RuleChecker(rules, ["doc_id"]), RequiredChecker(["lang"], ["doc_id"])])
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("findings"))


@query("F3_table_transform", "select doc_id, source, lang, row_number() over (partition by source, lang order by doc_id) as ordinal from documents")
def transform(spark, sf):
    from plumbline.operators.shred import outline
    return table(spark, sf, "documents").transform(outline, ["source"], "lang", "doc_id").select("doc_id", "source", "lang", "ordinal")
