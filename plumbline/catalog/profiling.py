"""Profiles, inference, and counts over findings."""

from pyspark.sql import functions as F

from plumbline.catalog import base, query, table, with_base
from plumbline.catalog.keys import PLACES, place_nodes
from plumbline.functions import types as Y
from plumbline.functions.model import compile_model
from plumbline.operators import check as C
from plumbline.operators import findings as N
from plumbline.operators import keys as K
from plumbline.operators import profile as P
from plumbline.operators import record as R
from plumbline.operators import rules as B
from plumbline.operators import sequence as Q

EVENT_COLS = ["event_type", "value", "props"]


@query("A1_profile", """
with n as (select 'event_type' as name, event_type as v from events union all select 'k', regexp_extract(props, '[0-9]+') from events union all select 'gap', case when event_id % 3 = 0 then ' ' end from events),
p as (select name, nullif(trim(v), '') as v, count(*) as c from n group by all)
select name, cast(sum(c) as bigint) as occurrences, count(v) > 0 as has_text, count(v) as distinct_values,
  coalesce((select string_agg(v, ',' order by v) from (select v from p q where q.name = p.name and v is not null order by v limit 64)), '') as "values" from p group by name""")
def profile(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_type", "regexp_extract(props, '[0-9]+', 0) as k", "case when event_id % 3 = 0 then ' ' end as gap")
    out = P.profile(P.as_nodes(df, ["event_type", "k", "gap"]))
    return out.select("name", "occurrences", "has_text", "distinct_values", F.array_join("values", ",").alias("values"))


@query("A1b_profile_values", """
with n as (select 'event_type' as name, event_type as v from events union all select 'k', regexp_extract(props, '[0-9]+') from events union all select 'value', cast(event_id as varchar) from events)
select name, nullif(trim(v), '') as value, count(*) as occurrences from n where nullif(trim(v), '') is not null group by all""")
def profile_values(spark, sf):
    """All values of every name, however many."""
    df = table(spark, sf, "events").selectExpr("event_type", "regexp_extract(props, '[0-9]+', 0) as k", "event_id as value")
    return P.profile_values(P.as_nodes(df, ["event_type", "k", "value"]))


@query("A2_infer_occurs", """
with c as (select l_orderkey, l_returnflag || l_linestatus as name, count(*) as n from lineitem group by all), t as (select count(*) as parents from orders)
select name, cast(case when count(*) < any_value(parents) then 0 else min(n) end as bigint) as min_occurs, case when max(n) <= 1 then max(n) end as max_occurs, max(n) as most_seen from c, t group by name""")
def occurs(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey", "concat(l_returnflag, l_linestatus) as name")
    return P.infer_occurs(table(spark, sf, "orders"), lines, ["l_orderkey"], "name", ["o_orderkey"])


@query("A3_infer_required", with_base("docs_gaps") + """
select f as field, n as present, n = total as required from (select count(*) as total, count(lang) as l, count(text) as t, count(source) as s from docs_gaps),
lateral (values ('lang', l), ('text', t), ('source', s)) x(f, n)""")
def required(spark, sf):
    return P.infer_required(base(spark, sf, "docs_gaps"), ["lang", "text", "source"])


@query("A4_infer_enumeration", """
with n as (select 'o_orderstatus' as field, o_orderstatus as v from orders union all select 'o_orderpriority', o_orderpriority from orders union all select 'o_orderkey', cast(o_orderkey as varchar) from orders
  union all select 'o_custkey', cast(o_custkey as varchar) from orders),
c as (select field, v, count(*) as n from n group by all)
select field, string_agg(v, ',' order by v) as enumeration from c group by field having count(*) between 2 and 8 and sum(n) > count(*)""")
def enumerations(spark, sf):
    out = P.infer_enumeration(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_orderkey", "o_custkey"])
    return out.select("field", F.array_join("enumeration", ",").alias("enumeration"))


def tag_nodes(spark, sf):
    """Tags of each page as nodes: name, text that follows, and whether another tag opens inside."""
    tags = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)[^>]*>([^<]*)(</?)"), F.lit(0))).alias("at", "tag"))
    return tags.select("page_id", "at", F.regexp_extract("tag", "<([a-z][a-z0-9]*)", 1).alias("name"), F.regexp_extract("tag", ">([^<]*)<", 1).alias("value"),
                       (~F.col("tag").endswith("</")).alias("kids"))


TAGS = """with tags as (select page_id, tag, regexp_extract(tag, '<([a-z][a-z0-9]*)', 1) as name, regexp_extract(tag, '>([^<]*)<', 1) as v, not ends_with(tag, '</') as kids
  from (select page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[^>]*>([^<]*)(</?)')) as tag from pages))
"""


@query("A5_infer_content_kind", TAGS + """
select name, case when bool_or(kids) and count(nullif(trim(v, ' '), '')) > 0 then 'mixed' when bool_or(kids) then 'element-only' else 'simple' end as content from tags group by name""")
def kinds(spark, sf):
    return P.content_kind(P.profile(tag_nodes(spark, sf), has_children="kids")).select("name", "content")


@query("A6_inference_caveats", TAGS + """
, p as (select name, count(*) as n, bool_or(kids) as kids, count(nullif(trim(v, ' '), '')) > 0 as txt from tags group by name)
select caveat, cast(c as bigint) as "count" from (select count(*) filter (n = 1) as once, count(*) filter (kids and txt) as mixed, count(*) as names from p),
lateral (values ('namespaces', 2), ('seen once', once), ('mixed content', mixed), ('all values typed as text', names)) x(caveat, c) where c > 0""")
def caveats(spark, sf):
    return P.inference_caveats(P.profile(tag_nodes(spark, sf), has_children="kids"), 2)


CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("A7_render_spec", """
select * from (values (1, 'c_custkey', 'integer', true, null), (2, 'c_name', 'string', true, null), (3, 'c_nationkey', 'integer', true, null), (4, 'c_acctbal', 'decimal', true, null)) t(place, field, type, required, enumeration)
union all select 5, 'c_mktsegment', 'string', count(c_mktsegment) = count(*), string_agg(distinct c_mktsegment, ',' order by c_mktsegment) from customer""")
def spec(spark, sf):
    out = P.render_spec(table(spark, sf, "customer"), CUSTOMER_COLS)
    return out.select(F.col("place").cast("int").alias("place"), "field", "type", "required", F.array_join("enumeration", ",").alias("enumeration"))


@query("A8_infer_type_lattice", """
with l as (select cast(l_linenumber as varchar) as n, cast(cast(l_discount as decimal(18,2)) as varchar) as d, cast(cast(l_shipdate as date) as varchar) as s, l_returnflag as f from lineitem),
u as (select 'n' as field, n as v from l union all select 'd', d from l union all select 's', s from l union all select 'f', f from l union all select 'url', url from pages)
select field, case when bool_and(v in ('0', '1', 'true', 'false')) then 'boolean' when bool_and(regexp_full_match(v, '[+-]?[0-9]+')) then 'integer'
  when bool_and(try_cast(v as decimal(30,6)) is not null) then 'decimal' when bool_and(try_cast(v as date) is not null) then 'date'
  when bool_and(regexp_full_match(v, '[a-z]+:\\S+')) then 'uri' else 'string' end as type from u group by field""")
def lattice(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_linenumber as n", "cast(l_discount as decimal(18,2)) as d", "cast(l_shipdate as date) as s", "l_returnflag as f")
    return P.infer_type_lattice(df, ["n", "d", "s", "f"]).unionByName(P.infer_type_lattice(table(spark, sf, "pages"), ["url"]))


@query("A9_follow_pairs", """
with w as (select event_type as s, lag(event_type) over w as p, lead(event_type) over w as n from events window w as (partition by user_id order by ts))
select symbol, next, count(*) as times from (select s as symbol, coalesce(n, '$') as next from w union all select '^', s from w where p is null) group by all""")
def follow(spark, sf):
    return P.follow_pairs(table(spark, sf, "events"), ["user_id"], "ts", "event_type")


LEARNT = {"conversations": ("conv_id", "turn", "role"), "events": ("user_id", "ts", "event_type")}


@query("A9b_observed_model", """
with r as (select conv_id as g, role as s, lag(role) over w as p, lead(role) over w as n from conversations window w as (partition by conv_id order by turn)),
e as (select event_type as s, lag(event_type) over w as p, lead(event_type) over w as n from events window w as (partition by user_id order by ts)),
pairs as (select 'conversations' as source, s as symbol, coalesce(n, '$') as next from r union all select 'conversations', '^', s from r where p is null
  union all select 'events', s, coalesce(n, '$') from e union all select 'events', '^', s from e where p is null),
found as (select source, symbol, next, count(*) as times from pairs group by all),
talk(symbol, next) as (values ('^', 'system'), ('^', 'user'), ('system', 'user'), ('user', 'assistant'), ('user', 'user'), ('assistant', 'user'), ('user', '$'), ('assistant', '$'))
select 'conversations' as source, symbol, next, coalesce(times, 0)::bigint as times from talk left join (select * from found where source = 'conversations') using (symbol, next)
union all select source, symbol, next, times from found where source = 'events'""")
def observed_model(spark, sf):
    """Every pair the learnt models allow, with how often it occurs. Conversations follow system? (user assistant?)+, which also
    allows a user after a user; the model of the events allows the observed pairs alone."""
    out = None
    for name, (key, order, symbol) in LEARNT.items():
        df = table(spark, sf, name)
        pairs = P.model_pairs(df, [key], order, symbol, P.observed_model(df, [key], order, symbol)).withColumn("source", F.lit(name))
        out = pairs if out is None else out.unionByName(pairs)
    return out


@query("A9c_observed_model_valid", "select 'conversations' as source, conv_id as g, true as valid from conversations group by conv_id union all select 'events', user_id, true from events group by user_id")
def observed_model_valid(spark, sf):
    """No group falls out of the model learnt from it."""
    out = None
    for name, (key, order, symbol) in LEARNT.items():
        df = table(spark, sf, name)
        model = compile_model(P.observed_model(df, [key], order, symbol))
        valid = Q.sequence_valid(Q.Groups(df, [key], order, symbol, model)).select(F.lit(name).alias("source"), F.col(key).alias("g"), "valid")
        out = valid if out is None else out.unionByName(valid)
    return out


@query("A10_infer_from_many", """
with n as (select source, 'lang' as name, lang as v from documents union all select source, 'half', case when doc_id % 2 = 0 then lang end from documents where true)
select name, count(*) as occurrences, count(v) > 0 as has_text, count(distinct v) as distinct_values, count(distinct source) filter (v is not null) as documents from n group by name""")
def many(spark, sf):
    df = table(spark, sf, "documents").withColumn("half", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return P.infer_from_many(df, "source", ["lang", "half"])


@query("A11_summary", """
with t as (select user_id % 4 as ns, event_type as name, length(props) as depth from events)
select count(*) as elements, cast(max(depth) as integer) as depth, count(distinct ns) as namespaces,
  (select string_agg(n || ' ' || lower(name), ', ' order by n desc, name) from (select name, count(*) as n from t group by name having count(*) > 1 order by n desc, name limit 3)) as mostly from t""")
def summary(spark, sf):
    df = table(spark, sf, "events").selectExpr("cast(user_id % 4 as string) as ns", "event_type as name", "length(props) as depth")
    return P.summary(df, namespace="ns")


@query("A13_shape_of", """
with c as (select l_orderkey, 'S' || l_suppkey % 7 as name, count(*) as n, min(l_partkey * 10 + l_linenumber) as first from lineitem group by all),
r as (select *, row_number() over (partition by l_orderkey order by first, name) as rn, count(*) over (partition by l_orderkey) as kinds from c)
select l_orderkey, 'Holds ' || string_agg(case when n = 1 then name else n || ' ' || name end, ', ' order by rn) || case when any_value(kinds) > 4 then ', and ' || any_value(kinds) - 4 || ' more' else '' end || '.' as shape
from r where rn <= 4 group by l_orderkey""")
def shapes(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey", "concat('S', l_suppkey % 7) as name", "l_partkey * 10 + l_linenumber as at")
    return P.shape_of(df, ["l_orderkey"], "name", "at")


def order_findings(spark, sf, limit="45"):
    """The flagship: status values, quantities, references and totals of orders."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    status = C.check_column(orders, "o_orderstatus", Y.builtin("token", enumeration=["O", "F"]), ["o_orderkey"], "o_orderkey")
    quantity = C.check_column(lines, "l_quantity", Y.builtin("double", max_inclusive=limit), ["l_orderkey", "l_linenumber"], "l_orderkey")
    refs = K.keyref(lines.withColumn("ref", F.when(F.col("l_partkey") % 41 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))), orders, {"ref": "o_orderkey"}, ["l_orderkey", "l_linenumber"])
    refs = refs.withColumn("doc_key", F.substring_index("row_key", "|", 1))
    parents = orders.selectExpr("o_orderkey as k", "cast(o_totalprice as decimal(18,2)) as total")
    children = lines.selectExpr("l_orderkey as k", "cast(l_extendedprice as decimal(18,2)) as price")
    totals = B.group_assert(parents, children, ["k"], {"s": F.sum("price")}, "total >= s", "the lines cost more than the order")
    totals = totals.withColumn("doc_key", F.col("row_key")).withColumn("severity", F.lit("warning"))
    return N.union_findings(status, quantity, refs, totals)


def counted(limit: int) -> str:
    return f"""(
select o_orderkey, coalesce(s, 0) + coalesce(q, 0) + coalesce(r, 0) as errors, coalesce(w, 0) as warnings from orders
left join (select o_orderkey, count(*) as s from orders where o_orderstatus not in ('O', 'F') group by 1) using (o_orderkey)
left join (select l_orderkey as o_orderkey, count(*) filter (l_quantity > {limit}) as q, count(*) filter (l_partkey % 41 = 0) as r from lineitem group by 1) using (o_orderkey)
left join (select o_orderkey, count(*) as w from orders left join (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as s from lineitem group by 1) on l_orderkey = o_orderkey
  where not coalesce(cast(o_totalprice as decimal(18,2)) >= s, false) group by 1) using (o_orderkey))"""


@query("A14_counts_by_file", f"select o_orderkey, errors, warnings from {counted(45)}")
def by_file(spark, sf):
    return N.counts_by_file(order_findings(spark, sf), table(spark, sf, "orders"), "o_orderkey")


@query("A15_rollup_worst", PLACES + """
, f as (select path, case when name like '%3' then 2 when name like '%5' then 1 else 0 end as r from places where name like '%3' or name like '%5' or name like '%8')
select p.path, case max(case when f.path = p.path then r end) when 2 then 'error' when 1 then 'warning' when 0 then 'info' end as here,
  case max(case when starts_with(f.path, p.path || '/') then r end) when 2 then 'error' when 1 then 'warning' when 0 then 'info' end as inside
from places p left join f on f.path = p.path or starts_with(f.path, p.path || '/') group by p.path""")
def rollup(spark, sf):
    nodes = place_nodes(spark, sf)
    found = nodes.where(F.col("name").rlike("[358]$")).select("path", F.when(F.col("name").endswith("3"), "error").when(F.col("name").endswith("5"), "warning").otherwise("info").alias("severity"))
    return N.rollup_worst(found, nodes)


@query("A16_verdict", f"select o_orderkey, errors = 0 as valid from {counted(45)}")
def verdicts(spark, sf):
    return N.verdict(order_findings(spark, sf), table(spark, sf, "orders"), "o_orderkey")


@query("A16b_verdict_of_all", """
with d as (select doc_id, case when doc_id % 7 = 0 then null else lang end as lang, case when doc_id % 5 = 0 then null else text end as text, source, n_chars from documents),
k as (select lang, n_chars, count(*) as n from d where lang is not null and n_chars is not null group by all)
select doc_id, d.lang is not null and d.text is not null and n is null and not coalesce(10000 // nullif(d.n_chars - 100, 0) > 40, false) and doc_id in (select doc_id from labels) as valid
from d left join k on d.lang = k.lang and d.n_chars = k.n_chars and n > 1""")
def verdict_of_all(spark, sf):
    """Findings of record, key, reference and rule operators, each with its document."""
    docs, labels = base(spark, sf, "docs_gaps"), table(spark, sf, "labels")
    found = [R.required_fields(docs, ["lang", "text"], ["source"], doc="doc_id"), K.unique(docs, ["lang", "n_chars"], ["source"], doc="doc_id"),
             K.keyref(docs, labels, {"doc_id": "doc_id"}, ["source"], doc="doc_id"),
             R.assert_record(docs, "not (10000 div (n_chars - 100) > 40)", ["source"], doc="doc_id")]
    return N.verdict(N.union_findings(*found), docs, "doc_id")


@query("A17_verdict_delta", f"""
select b.o_orderkey, b.errors as errors_before, a.errors as errors_after, b.warnings as warnings_before, a.warnings as warnings_after,
  case when b.errors = 0 and a.errors > 0 then 'broke' when b.errors > 0 and a.errors = 0 then 'fixed' when a.errors = b.errors then 'same' when a.errors > b.errors then 'worse' else 'better' end as change
from {counted(45)} b join {counted(30)} a using (o_orderkey)""")
def delta(spark, sf):
    orders = table(spark, sf, "orders")
    before, after = (N.counts_by_file(order_findings(spark, sf, limit), orders, "o_orderkey") for limit in ("45", "30"))
    return N.verdict_delta(before, after, "o_orderkey")


@query("K1_limit_per_document", """
select doc_key, row_key from (select l_suppkey as doc_key, l_orderkey || '|' || l_linenumber || '|' || l_partkey as row_key, row_number() over (partition by l_suppkey order by l_orderkey, l_orderkey || '|' || l_linenumber || '|' || l_partkey) as rn from lineitem where l_quantity > 20)
where rn <= 50""")
def limited(spark, sf):
    found = C.check_column(table(spark, sf, "lineitem"), "l_quantity", Y.builtin("double", max_inclusive="20"), ["l_orderkey", "l_linenumber", "l_partkey"], "l_suppkey")
    placed = found.withColumn("ordinal", F.substring_index("row_key", "|", 1).cast("long"))
    return N.limit_per_document(placed, 50).select(F.col("doc_key").cast("long").alias("doc_key"), "row_key")


@query("K4_top_repeated", "select event_type, count(*) as occurrences from events group by event_type having count(*) > 1 order by 2 desc, 1 limit 3")
def top(spark, sf):
    return P.top_repeated(table(spark, sf, "events"), "event_type")


@query("U1_union_findings", f"""
select source, severity, count(*) as findings from (
  select 'schema' as source, 'error' as severity from orders where o_orderstatus not in ('O', 'F')
  union all select 'schema', 'error' from lineitem where l_quantity > 45 union all select 'schema', 'error' from lineitem where l_partkey % 41 = 0
  union all select 'rules', 'warning' from {counted(45)}, generate_series(1, warnings)) group by all""")
def union(spark, sf):
    return order_findings(spark, sf).groupBy("source", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query("U2_unknown_names", with_base("event_names") + """
select name, count(*) as uses from event_names where name not in ('click', 'view', 'error', 'purchase', 'signup') group by name""")
def unknown(spark, sf):
    names = base(spark, sf, "event_names").groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    allowed = table(spark, sf, "events").select(F.col("event_type").alias("name")).distinct()
    return names.join(allowed, "name", "left_anti")


@query("U3_distinct_namespaces", "select distinct regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages")
def hosts(spark, sf):
    return table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).distinct()


@query("U4_merge_columns", """
select event_id, case when event_type = 'purchase' then value end as amount, case when event_type = 'error' then props end as detail, case when event_type not in ('purchase', 'error') then event_type end as kind from events""")
def merged(spark, sf):
    e = table(spark, sf, "events")
    return N.merge_columns([e.where("event_type = 'purchase'").selectExpr("event_id", "value as amount"), e.where("event_type = 'error'").selectExpr("event_id", "props as detail"),
                            e.where("event_type not in ('purchase', 'error')").selectExpr("event_id", "event_type as kind")])
