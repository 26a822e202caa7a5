"""Types and facets over orders, lineitem, part, customer, events, documents and embeddings."""

from pyspark.sql import functions as F

from plumbline.catalog import base, query, table, with_base
from plumbline.functions import lexical as L
from plumbline.functions import types as Y
from plumbline.functions.text import normalize_space
from plumbline.operators import check as C
from plumbline.operators import spec_rows as H
from plumbline.operators import vocabulary as V

TAB = "chr(9) || chr(10) || chr(13)"
DECIMAL = r"'[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)'"


@query("T1_normalize_space", f"""
select doc_id, length(t) as length, md5(t) as digest
from (select doc_id, regexp_replace(trim(translate(text, {TAB}, '   '), ' '), ' {{2,}}', ' ', 'g') as t from documents)""")
def normalise(spark, sf):
    t = normalize_space(F.col("text"), "collapse")
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("length"), F.md5(t).alias("digest"))


@query("T2_is_lexical", with_base("line_text") + f"""
select l_orderkey, l_linenumber, l_partkey,
  regexp_full_match(qty, {DECIMAL}) as is_decimal, regexp_full_match(price, {DECIMAL}) as price_decimal,
  l_linestatus = '1' as is_boolean,
  regexp_full_match('P' || qty || 'D', 'P[0-9]+D') as is_duration,
  regexp_full_match('0' || qty, '([0-9a-fA-F]{{2}})*') as is_hex
from line_text""")
def lexical(spark, sf):
    df, c = base(spark, sf, "line_text"), F.col
    return df.select("l_orderkey", "l_linenumber", "l_partkey", L.is_lexical(c("qty"), "decimal").alias("is_decimal"),
                     L.is_lexical(c("price"), "decimal").alias("price_decimal"), L.is_lexical(c("l_linestatus"), "boolean").alias("is_boolean"),
                     L.is_lexical(F.concat(F.lit("P"), c("qty"), F.lit("D")), "duration").alias("is_duration"),
                     L.is_lexical(F.concat(F.lit("0"), c("qty")), "hexBinary").alias("is_hex"))


@query("T3_is_real_date", with_base("order_text") + """
select o_orderkey, odate, try_cast(odate as date) is not null as is_date,
  try_cast('2024' || substr(odate, 5) as date) is not null as is_month_day
from order_text""")
def real_date(spark, sf):
    month_day = F.concat(F.lit("-"), F.substring("odate", 5, 6))
    return base(spark, sf, "order_text").select("o_orderkey", "odate", L.is_lexical(F.col("odate"), "date").alias("is_date"),
                                                L.is_lexical(month_day, "gMonthDay").alias("is_month_day"))


@query("T4_is_builtin", with_base("line_text", "part_text") + r"""
select 'line' as origin, l_partkey as k, qty as v,
  regexp_full_match(qty, '[+-]?[0-9]+(\.0*)?') and try_cast(qty as decimal(20,2)) between 1 and 10000000000 as positive,
  regexp_full_match(qty, '[+-]?[0-9]+(\.0*)?') and try_cast(qty as decimal(20,2)) between -128 and 127 as byte,
  false as name, regexp_full_match(qty, '[-.0-9A-Za-z_:]+') as nmtoken from line_text
union all
select 'part', p_partkey, brand, false, false, false, regexp_full_match(brand, '[-.0-9A-Za-z_:]+') from part_text
union all
select 'type', p_partkey, p_type, false, false, regexp_full_match(p_type, '[A-Za-z_:][-.0-9A-Za-z_:]*'), regexp_full_match(p_type, '[-.0-9A-Za-z_:]+') from part_text""")
def builtin(spark, sf):
    lines, parts = base(spark, sf, "line_text"), base(spark, sf, "part_text")
    both = (lines.select(F.lit("line").alias("origin"), F.col("l_partkey").alias("k"), F.col("qty").alias("v"))
            .unionByName(parts.select(F.lit("part").alias("origin"), F.col("p_partkey").alias("k"), F.col("brand").alias("v")))
            .unionByName(parts.select(F.lit("type").alias("origin"), F.col("p_partkey").alias("k"), F.col("p_type").alias("v"))))
    is_a = lambda t: Y.is_valid(F.col("v"), Y.builtin(t))
    return both.select("origin", "k", "v", is_a("positiveInteger").alias("positive"), is_a("byte").alias("byte"),
                       is_a("Name").alias("name"), is_a("NMTOKEN").alias("nmtoken"))


@query("T5_to_value", with_base("order_text") + """
select o_orderkey, case when try_cast(odate as date) is not null then cast(epoch(cast(try_cast(odate as date) as timestamp)) as bigint) end as seconds,
  cast(cast(total as decimal(18,2)) * 100 as bigint) as cents,
  (o_orderkey % 30) * 12 + 3 as months, cast((o_orderkey % 5) * 86400 + 90 as bigint) as secs
from order_text""")
def to_value(spark, sf):
    span = F.concat(F.lit("P"), (F.col("o_orderkey") % 30).cast("string"), F.lit("Y3M"), (F.col("o_orderkey") % 5).cast("string"), F.lit("DT1M30S"))
    d = L.to_value(span, "duration")
    return base(spark, sf, "order_text").select(
        "o_orderkey", L.to_value(F.col("odate"), "date").cast("long").alias("seconds"),
        (L.to_value(F.col("total"), "decimal").cast("decimal(20,2)") * 100).cast("long").alias("cents"),
        d["months"].alias("months"), d["seconds"].cast("long").alias("secs"))


@query("T6_compare", """
select o_orderkey, cast(case when months = m2 then sign(s - s2) when s = s2 then sign(months - m2)
                        when sign(months - m2) = sign(s - s2) then sign(s - s2) end as integer) as order_1,
  cast(sign(o_totalprice - 250000) as integer) as order_2
from (select o_orderkey, o_totalprice, o_orderkey % 4 as months, (o_orderkey % 3) * 86400 as s, 2 as m2, 86400 as s2 from orders)""")
def compare(spark, sf):
    k = F.col("o_orderkey")
    span = F.concat(F.lit("P"), (k % 4).cast("string"), F.lit("M"), (k % 3).cast("string"), F.lit("D"))
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", L.compare(span, F.lit("P2M1D"), "duration").alias("order_1"),
                     L.compare(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("250000"), "decimal").alias("order_2"))


@query("T7_value_length", """
select doc_id, length(text) as points, octet_length(encode(text)) as hex_octets, octet_length(encode(text)) as base64_octets from documents""")
def lengths(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", L.value_length(t).cast("long").alias("points"), L.value_length(F.hex(t), "hexBinary").cast("long").alias("hex_octets"),
        L.value_length(F.base64(t), "base64Binary").cast("long").alias("base64_octets"))


def _codes(df, col, t, key):
    return C.check_column(df, col, t, key).select("row_key", "code")


@query("T8_length_facets", """
select cast(c_custkey as varchar) as row_key, unnest(list_filter([case when length(m) < 9 then 'cvc-minLength-valid' end,
  case when length(m) > 9 then 'cvc-maxLength-valid' end, case when length(m) <> 10 then 'cvc-length-valid' end], lambda x: x is not null)) as code
from (select c_custkey, c_mktsegment as m from customer)""")
def length_facets(spark, sf):
    t = Y.builtin("string", min_length=9, max_length=9, length=10)
    return _codes(table(spark, sf, "customer"), "c_mktsegment", t, ["c_custkey"])


@query("T9_pattern", with_base("part_text") + r"""
select cast(p_partkey as varchar) as row_key, 'cvc-pattern-valid' as code from part_text
where not (regexp_full_match(brand, 'Brand#[0-9]{1,2}|brand#[0-9]+') and regexp_full_match(brand, '[A-Z].*'))""")
def pattern(spark, sf):
    first = Y.builtin("string", pattern=[r"Brand#\d{1,2}", r"brand#\d+"])
    second = Y.derive(first, "capital", pattern=r"\p{Lu}[\c#-[:]]*")
    return _codes(base(spark, sf, "part_text"), "brand", second, ["p_partkey"])


@query("T11_enumeration", with_base("order_text") + """
select cast(o_orderkey as varchar) as row_key, 'cvc-enumeration-valid' as code from order_text where status not in ('O', 'F', 'P')""")
def enumeration(spark, sf):
    return _codes(base(spark, sf, "order_text"), "status", Y.builtin("token", enumeration=["O", "F", "P"]), ["o_orderkey"])


@query("T11b_vocabulary", with_base("part_names") + """
select cast(p_partkey as varchar) as row_key, 'cvc-enumeration-valid' as code, 'name: ' || name || ' is not a listed value' as message
from part_names where name is not null and name not in (select p_name from part where p_name is not null)""")
def listed(spark, sf):
    """Names of parts against the names of all parts, as a table."""
    words = V.vocabulary(table(spark, sf, "part"), "p_name")
    return V.check_vocabulary(base(spark, sf, "part_names"), "name", words, ["p_partkey"]).select("row_key", "code", "message")


@query("T12_range", with_base("line_text", "order_text") + """
select l_orderkey || '|' || l_linenumber as row_key, 'cvc-range-valid' as code from line_text where cast(qty as decimal(10,2)) < 5
union all select l_orderkey || '|' || l_linenumber, 'cvc-range-valid' from line_text where cast(qty as decimal(10,2)) > 45
union all select cast(o_orderkey as varchar), 'cvc-range-valid' from order_text where try_cast(odate as date) < date '1995-03-01'
union all select cast(o_orderkey as varchar), 'cvc-datatype-valid.1.2.1' from order_text where try_cast(odate as date) is null""")
def ranges(spark, sf):
    number = Y.builtin("decimal", min_inclusive="5", max_inclusive="45")
    day = Y.builtin("date", min_inclusive="1995-03-01")
    lines = base(spark, sf, "line_text")
    return _codes(lines, "qty", number, ["l_orderkey", "l_linenumber"]).unionByName(_codes(base(spark, sf, "order_text"), "odate", day, ["o_orderkey"]))


@query("T13_digits", with_base("line_text") + r"""
select rk as row_key, unnest(list_filter([case when not ok then 'cvc-datatype-valid.1.2.1' end,
  case when ok and length(f) > 1 then 'cvc-fractionDigits-valid' end, case when ok and length(w) + length(f) > 6 then 'cvc-totalDigits-valid' end], lambda x: x is not null)) as code
from (select l_orderkey || '|' || l_linenumber || '|' || l_partkey as rk, not contains(price, ',') as ok,
             ltrim(split_part(price, '.', 1), '0') as w, rtrim(split_part(price, '.', 2), '0') as f from line_text)""")
def digit_facets(spark, sf):
    return _codes(base(spark, sf, "line_text"), "price", Y.builtin("decimal", total_digits=6, fraction_digits=1), ["l_orderkey", "l_linenumber", "l_partkey"])


@query("T14_explicit_timezone", """
select cast(event_id as varchar) as row_key, 'cvc-explicitTimezone-valid' as code from events where event_id % 3 <> 0""")
def timezone(spark, sf):
    zone = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+05:30")).otherwise("")
    df = table(spark, sf, "events").withColumn("at", F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), zone))
    return _codes(df, "at", Y.builtin("dateTimeStamp"), ["event_id"])


@query("T15_check_list", """
with w as (select doc_id, list_filter(string_split(regexp_replace(trim(translate(text, chr(9) || chr(10) || chr(13), '   '), ' '), ' {2,}', ' ', 'g'), ' '), lambda x: x <> '') as items from documents)
select cast(doc_id as varchar) as row_key, 'cvc-maxLength-valid' as code, cast(1 as bigint) as n from w where len(items) > 200
union all select cast(doc_id as varchar), 'cvc-maxLength-valid', cast(len(list_filter(items, lambda x: length(x) > 12)) as bigint) from w
where len(list_filter(items, lambda x: length(x) > 12)) > 0""")
def lists(spark, sf):
    words = Y.list_of(Y.builtin("token", max_length=12), "words", max_length=200)
    found = C.check_column(table(spark, sf, "documents"), "text", words, ["doc_id"])
    inner = F.col("message").startswith("text: item ")
    return found.groupBy("row_key", "code", inner.alias("_inner")).agg(F.count(F.lit(1)).alias("n")).drop("_inner")


@query("T16_check_union", """
select event_id, v, case when regexp_full_match(v, '[0-9]+') and cast(v as integer) <= 20 then 'small' when v in ('40', 'k60', 'k80') then 'named' end as member
from (select event_id, case when event_id % 2 = 0 then 'k' else '' end || regexp_extract(props, '[0-9]+') as v from events)""")
def unions(spark, sf):
    t = Y.union_of([Y.builtin("int", name="small", max_inclusive="20"), Y.builtin("token", name="named", enumeration=["40", "k60", "k80"])], "either")
    v = F.concat(F.when(F.col("event_id") % 2 == 0, "k").otherwise(""), F.regexp_extract("props", "[0-9]+", 0))
    return table(spark, sf, "events").select("event_id", v.alias("v")).withColumn("member", Y.matched_member(F.col("v"), t))


@query("T18_check_column", with_base("order_text") + """
select cast(o_orderkey as varchar) as row_key, 'status' as field, 'cvc-enumeration-valid' as code from order_text where status not in ('O', 'F', 'P')
union all select cast(o_orderkey as varchar), 'total', 'cvc-range-valid' from order_text where cast(total as decimal(18,2)) > 400000
union all select cast(o_orderkey as varchar), 'odate', 'cvc-datatype-valid.1.2.1' from order_text where try_cast(odate as date) is null
union all select cast(o_orderkey as varchar), 'odate', 'cvc-range-valid' from order_text where try_cast(odate as date) > date '2000-06-30'
union all select cast(o_orderkey as varchar), 'priority', 'cvc-pattern-valid' from order_text where not regexp_full_match(trim(priority, ' '), '[1-5]-[A-Z ]+')""")
def whole_table(spark, sf):
    spec = {"status": Y.builtin("token", enumeration=["O", "F", "P"]), "total": Y.builtin("decimal", max_inclusive="400000", fraction_digits=2),
            "odate": Y.builtin("date", max_inclusive="2000-06-30"), "priority": Y.builtin("token", pattern="[1-5]-[A-Z ]+")}
    found = C.check_table(base(spark, sf, "order_text"), spec, ["o_orderkey"])
    return found.select("row_key", F.col("column").alias("field"), "code")


@query("T20_fixed_value", with_base("order_text") + """
select cast(o_orderkey as varchar) as row_key, 'raw' as side from order_text where priority <> '5-LOW'
union all select cast(o_orderkey as varchar), 'text' from order_text where regexp_replace(trim(priority, ' '), ' {2,}', ' ', 'g') <> '5 LOW'""")
def fixed(spark, sf):
    df = base(spark, sf, "order_text")
    raw = C.check_fixed(df, "priority", "5-LOW", ["o_orderkey"]).select("row_key", F.lit("raw").alias("side"))
    return raw.unionByName(C.check_fixed(df, "priority", "5 LOW", ["o_orderkey"], Y.builtin("token")).select("row_key", F.lit("text").alias("side")))


@query("T21_fill_defaults", with_base("docs_gaps") + """
select doc_id, coalesce(lang, 'en') as lang, coalesce(text, '') as text, source from docs_gaps""")
def defaults(spark, sf):
    spec = {"lang": {"type": Y.builtin("string", enumeration=["en"])}, "text": {"default": ""}, "source": {}}
    return C.fill_defaults(base(spark, sf, "docs_gaps"), spec).select("doc_id", "lang", "text", "source")


@query("T23_spec_health", """
with brands as (select distinct p_brand as b from part), loose as (select b from brands where cast(regexp_extract(b, '[0-9]+') as integer) > 10)
select b as name, 'facet-loosens-base' as code, 'warning' as severity from loose""")
def health(spark, sf):
    """Specs held as rows, one type per brand of the part table: maximum length two digits of the brand, over
    a base that allows ten; brands above ten loosen it."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    ten = spark.range(1)
    types = brands.select("name", F.lit("ten").alias("base")).unionByName(ten.select(F.lit("ten").alias("name"), F.lit("string").alias("base")))
    facets = brands.select("name", F.lit("max_length").alias("facet"), F.split_part("name", F.lit("#"), F.lit(2)).alias("value"), F.lit(False).alias("fixed"))
    facets = facets.unionByName(ten.select(F.lit("ten").alias("name"), F.lit("max_length").alias("facet"), F.lit("10").alias("value"), F.lit(False).alias("fixed")))
    return H.type_health(types, facets).select(F.col("rule_id").alias("name"), "code", "severity")


@query("T23b_spec_health_tree", """
with recursive t as (select p_partkey as k, case when p_partkey % 101 = 7 then -1 else p_partkey // 2 end as b, case when p_partkey % 97 <> 5 then p_size end as v, p_partkey % 50 = 3 as fixed from part),
up as (select k, b as anc from t where b >= 0 union select up.k, t.b from up join t on t.k = up.anc where t.b >= 0),
over as (select distinct up.k from up join t on t.k = up.anc where t.fixed and up.anc <> up.k),
low as (select up.k, min(t.v) as v from up join t on t.k = up.anc where up.anc <> up.k and t.k not in (select k from over) group by up.k)
select 'p' || k as name, 'bad-facet-value' as code from t where v is null and k not in (select k from over)
union all select 'nowhere', 'unresolved-reference' where exists (select 1 from t where b < 0)
union all select 'p' || k, 'circular-type' from up where k = anc
union all select 'p' || k, 'fixed-facet-overridden' from over
union all select 'p' || t.k, 'facet-loosens-base' from t join low using (k) where t.v > low.v and k not in (select k from over)""")
def health_tree(spark, sf):
    """One type per part, each derived from the part with half its number, with its size as maximum length."""
    k = F.col("p_partkey")
    part = table(spark, sf, "part").withColumn("name", F.concat(F.lit("p"), k.cast("string")))
    base = F.when(k % 101 == 7, "nowhere").otherwise(F.concat(F.lit("p"), F.floor(k / 2).cast("string")))
    facets = part.select("name", F.lit("max_length").alias("facet"), F.when(k % 97 == 5, "x").otherwise(F.col("p_size").cast("string")).alias("value"), (k % 50 == 3).alias("fixed"))
    return H.type_health(part.select("name", base.alias("base")), facets).select(F.col("rule_id").alias("name"), "code")
