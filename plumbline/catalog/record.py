"""Record-shape operators over documents, events, customers, orders and lines."""

from pyspark.sql import functions as F

from plumbline.catalog import base, query, table, with_base
from plumbline.functions import types as Y
from plumbline.operators import record as R

PROPS = "from_json(props, 'map<string,string>')"


@query("R1_required_fields", with_base("docs_gaps") + """
select cast(doc_id as varchar) as row_key, 'lang' as field, 'cvc-complex-type.4' as code from docs_gaps where lang is null
union all select cast(doc_id as varchar), 'text', 'cvc-complex-type.4' from docs_gaps where text is null""")
def required(spark, sf):
    return R.required_fields(base(spark, sf, "docs_gaps"), ["lang", "text", "source"], ["doc_id"]).select("row_key", F.col("column").alias("field"), "code")


@query("R2_unexpected_fields", """
select cast(event_id as varchar) as row_key, f as field, case when f = 'valu' then 'value' end as rename_to from (
  select event_id, unnest(['k', case when event_id % 3 = 0 then 'valu' else 'value' end, case when event_id % 4 = 0 then 'colour' else 'k' end]) as f from events)
where f not in ('k', 'value') group by all""")
def unexpected(spark, sf):
    k = F.col("event_id")
    fields = F.array_distinct(F.concat(F.json_object_keys("props"), F.array(
        F.when(k % 3 == 0, "valu").otherwise("value"), F.when(k % 4 == 0, "colour").otherwise("k"))))
    found = R.unexpected_fields(table(spark, sf, "events"), fields, ["k", "value"], ["event_id"])
    return found.select("row_key", F.col("column").alias("field"), F.get("fixes", F.lit(0))["value"].alias("rename_to"))


@query("R3_field_status", """
select c_custkey, cast(row_number() over (partition by c_custkey order by rank, pos) - 1 as integer) as place, field, value is not null as present, value, problems from (
  select c_custkey, 0 as rank, 1 as pos, 'c_name' as field, c_name as value, 0 as problems from customer
  union all select c_custkey, case when c_custkey % 3 = 0 then 2 else 1 end, 0, 'segment', case when c_custkey % 3 = 0 then null else c_mktsegment end,
    case when c_custkey % 3 <> 0 and c_mktsegment not in ('BUILDING', 'MACHINERY') then 1 else 0 end from customer
  union all select c_custkey, 1, 2, 'nation', cast(c_nationkey as varchar), case when c_nationkey > 20 then 1 else 0 end from customer)""")
def status(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "case when c_custkey % 3 = 0 then null else c_mktsegment end as segment", "c_nationkey as nation")
    spec = {"segment": {"type": Y.builtin("string", enumeration=["BUILDING", "MACHINERY"])},
            "c_name": {"type": Y.builtin("string"), "required": True}, "nation": {"type": Y.builtin("int", max_inclusive="20")}}
    return R.field_status(df, spec, ["c_custkey"])


@query("R4_empty_content", "select cast(o_orderkey as varchar) as row_key from orders where o_orderstatus = 'P' and o_orderkey in (select l_orderkey from lineitem)")
def empty(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_orderkey", "k")
    return R.empty_content(orders, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"]).select("row_key")


@query("R5_text_not_allowed", """
with e as (select page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[^>]*>([^<]*)', 1)) as tag, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[^>]*>([^<]*)', 2)) as own,
  unnest(range(len(regexp_extract_all(html, '<([a-z][a-z0-9]*)[^>]*>([^<]*)', 1)))) as place from pages)
select page_id || '|' || place || '|' || tag as row_key from e where tag in ('title', 'p', 'b', 'ul', 'nav', 'div') and regexp_matches(own, '\\S')""")
def no_text(spark, sf):
    """The text that follows every start tag, in elements that are to hold other elements only."""
    element = F.lit("<([a-z][a-z0-9]*)[^>]*>([^<]*)")
    pairs = F.arrays_zip(F.regexp_extract_all("html", element, F.lit(1)).alias("tag"), F.regexp_extract_all("html", element, F.lit(2)).alias("own_text"))
    nodes = table(spark, sf, "pages").select("page_id", F.posexplode(pairs).alias("place", "e")).select("page_id", "place", "e.tag", "e.own_text")
    return R.text_not_allowed(nodes, F.col("tag").isin("title", "p", "b", "ul", "nav", "div"), "own_text", ["page_id", "place", "tag"]).select("row_key")


@query("R6_undeclared", with_base("event_names") + """
select cast(event_id as varchar) as row_key, case when ns is null then 'cvc-elt.1' else 'namespace-mismatch' end as code from (
  select event_id, case when starts_with(name, 'x:') then 'x' end as ns, replace(name, 'x:', '') as local from event_names)
where (ns is null and local not in ('click', 'view', 'error', 'purchase', 'signup')) or ns is not null""")
def undeclared(spark, sf):
    df = base(spark, sf, "event_names").selectExpr("event_id", "case when name like 'x:%' then 'x' end as ns", "replace(name, 'x:', '') as local")
    declared = [(None, n) for n in ("click", "view", "error", "purchase", "signup")]
    return R.undeclared(df, "local", declared, ["event_id"], "ns").select("row_key", "code")


@query("R7_abstract_used", """
select cast(p_partkey as varchar) as row_key, case p_type when 'ECONOMY' then 2 else 0 end as substitutes from part where p_type in ('ECONOMY', 'PROMO')""")
def abstract(spark, sf):
    found = R.abstract_used(table(spark, sf, "part"), "p_type", {"ECONOMY": ["STANDARD", "SMALL"], "PROMO": []}, ["p_partkey"])
    return found.select("row_key", F.size("fixes").alias("substitutes"))


@query("R8_select_type", """
select event_id, case when event_type = 'purchase' and value > 20 then 'BigSale' when event_type = 'purchase' then 'Sale' when event_type = 'error' then 'Fault' else 'Plain' end as type from events""")
def conditional(spark, sf):
    rules = [("no_such_column = 1", "Never"), ("event_type = 'purchase' and value > 20", "BigSale"), ("event_type = 'purchase'", "Sale"),
             ("event_type = 'error'", "Fault"), (None, "Plain")]
    return R.select_type(table(spark, sf, "events"), rules, "Any").select("event_id", "type")


@query("R9_type_override", """
select doc_id, case source when 'src1' then 'News' when 'src2' then 'Blog' else 'Text' end as type from documents""")
def override(spark, sf):
    df = table(spark, sf, "documents").withColumn("declared", F.lit("Text")).withColumn("tag", F.concat(F.lit(" "), "source"))
    return R.type_override(df, "tag", "declared", {"src1": "News", "src2": "Blog"}).select("doc_id", "type")


@query("R10_assert_record", """
select l_orderkey || '|' || l_linenumber as row_key, 'cvc-assertion-valid' as code from lineitem
where not coalesce(case when l_discount > 0.08 then null else l_discount end <= 0.05 or l_quantity < 10, false)""")
def asserted(spark, sf):
    test = "case when l_discount > 0.08 then null else l_discount end <= 0.05 or l_quantity < 10"
    return R.assert_record(table(spark, sf, "lineitem"), test, ["l_orderkey", "l_linenumber"]).select("row_key", "code")


FLAGS = {"A": (1, 2), "N": (0, 1)}


@query("R11_unordered_members", """
with l as (select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey, l_returnflag order by l_partkey * 100000 + l_suppkey * 100 + l_linenumber) as rn from (
  select distinct l_orderkey, l_returnflag, l_partkey, l_suppkey, l_linenumber from lineitem))
select cast(l_orderkey as varchar) as doc_key, l_returnflag as field, 'cvc-complex-type.2.4.d' as code from l where l_returnflag = 'R'
union all select cast(l_orderkey as varchar), l_returnflag, 'cvc-complex-type.2.4.b' from l where (l_returnflag = 'A' and rn > 2) or (l_returnflag = 'N' and rn > 1)
union all select cast(o_orderkey as varchar), 'A', 'cvc-complex-type.2.4.b' from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')""")
def unordered(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey as k", "l_returnflag", "l_partkey * 100000 + l_suppkey * 100 + l_linenumber as at").distinct()
    orders = table(spark, sf, "orders").selectExpr("o_orderkey as k")
    return R.unordered_members(orders, lines, ["k"], "l_returnflag", "at", FLAGS).select("doc_key", F.col("column").alias("field"), "code")


@query("R12_cardinality", """
with c as (select l_orderkey as k, l_returnflag as name, count(*) as n from lineitem group by all)
select o_orderkey as k, s.name, coalesce(n, 0) as present, coalesce(n, 0) || ' of ' || case when s.hi is null then lo || '+' else lo || '–' || hi end as chip,
  case when coalesce(n, 0) < lo then 'too few' when coalesce(n, 0) > hi then 'too many' else 'ok' end as state
from orders, (values ('A', 1, 3), ('N', 0, 2), ('R', 1, null)) s(name, lo, hi) left join c on c.k = o_orderkey and c.name = s.name""")
def cardinality(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey as k", "l_returnflag")
    out = R.cardinality(table(spark, sf, "orders").selectExpr("o_orderkey as k"), lines, ["k"], "l_returnflag", {"A": (1, 3), "N": (0, 2), "R": (1, None)})
    return out.select("k", "name", "present", "chip", "state")


@query("R13_open_content", """
with last as (select user_id, max(epoch_us(ts)) as t from events where event_type not in ('view', 'click') group by user_id)
select event_id, 'suffix' as mode from events join last using (user_id) where epoch_us(ts) <= t
union all select event_id, 'interleave' from events where event_type not in ('view', 'click')""")
def open_content(spark, sf):
    df, hit = table(spark, sf, "events"), F.col("event_type").isin("view", "click")
    one = R.open_content(df, ["user_id"], "ts", hit, "suffix").select("event_id", F.lit("suffix").alias("mode"))
    return one.unionByName(R.open_content(df, ["user_id"], "ts", hit, "interleave").select("event_id", F.lit("interleave").alias("mode")))


@query("R14_namespace_allowed", with_base("docs_gaps") + """
select doc_id, lang is not null and lang <> 'fr' as other, lang is null or lang in ('de', 'en') as listed, true as anything from docs_gaps""")
def namespaces(spark, sf):
    lang = F.col("lang")
    return base(spark, sf, "docs_gaps").select("doc_id", R.namespace_allowed(lang, "other", "fr").alias("other"),
                                               R.namespace_allowed(lang, [None, "de", "en"]).alias("listed"), R.namespace_allowed(lang, "any").alias("anything"))


@query("R15_missing_count", """
with c as (select l_orderkey as k, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'R') as r from lineitem group by 1)
select o_orderkey as k, cast(case when o_orderkey % 6 = 0 then 1 else 0 end + greatest(0, 1 - coalesce(a, 0)) + greatest(0, 2 - coalesce(r, 0)) as bigint) as missing
from orders left join c on c.k = o_orderkey""")
def missing(spark, sf):
    orders = table(spark, sf, "orders").selectExpr("o_orderkey as k", "case when o_orderkey % 6 = 0 then null else o_orderpriority end as priority", "o_orderstatus")
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey as k", "l_returnflag")
    need = R.cardinality(orders, lines, ["k"], "l_returnflag", {"A": (1, None), "R": (2, None)})
    lacking = need.groupBy("k").agg(F.sum(F.greatest(F.col("min") - F.col("present"), F.lit(0))).alias("missing"))
    return R.missing_count(orders, ["priority", "o_orderstatus"], lacking, ["k"])


@query("R16_nil_rule", """
select cast(event_id as varchar) as row_key, case when event_type = 'error' then 'cvc-elt.3.1' else 'cvc-elt.3.2.1' end as code
from events where event_id % 5 = 0 and (event_type = 'error' or event_id % 2 = 0)""")
def nil(spark, sf):
    df = table(spark, sf, "events").withColumn("shown", F.when(F.col("event_id") % 2 == 0, F.col("value")))
    return R.nil_rule(df, F.col("event_id") % 5 == 0, "shown", ["event_id"], F.col("event_type") != "error").select("row_key", "code")
