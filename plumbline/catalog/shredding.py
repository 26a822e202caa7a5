"""Documents in and out, shredding, and tables made of nodes. Documents are derived from the tables."""

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.operators import shred as S
from plumbline.sources import documents as D
from plumbline.streaming.monitor import run_dir

ORDER = "order_id STRING, status STRING, line ARRAY<STRUCT<sku: STRING, qty: STRING>>"


def nested_orders(spark, sf):
    """Orders as nested records with none to three parts, all derived from the order's own row."""
    line = lambda i: F.struct(F.concat(F.lit("P"), ((F.col("o_orderkey") * 7 + i) % 1000).cast("string")).alias("sku"),
                              ((F.col("o_orderkey") + i) % 50).cast("string").alias("qty"))
    n = (F.col("o_custkey") % 4).cast("int")
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), line))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.struct(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_orderstatus").alias("status"), lines.alias("line")).alias("order"))


LINES = """with l as (select k, i, 'P' || (k * 7 + i) % 1000 as sku, (k + i) % 50 as qty from (select o_orderkey as k, unnest(generate_series(1, o_custkey % 4)) as i from orders))
"""


def order_documents(spark, sf):
    """The same as XML text; every 20th is cut short."""
    doc = D.to_xml_col("order", "order")
    return nested_orders(spark, sf).select("k", F.when(F.col("k") % 20 == 3, F.substring(doc, 1, 30)).otherwise(doc).alias("content"))


@query("S1_read_documents", LINES + """
select o_orderkey as k, o_orderkey % 20 = 3 as corrupt, case when o_orderkey % 20 <> 3 then o_orderstatus end as status, case when o_orderkey % 20 <> 3 then o_custkey % 4 end as lines,
  cast((select sum(qty) from l where l.k = o_orderkey and l.k % 20 <> 3) as bigint) as units from orders""")
def read(spark, sf):
    """Documents written to files, one on each line, and read back; every 20th has a wrong end tag and comes back as its text alone."""
    doc = D.to_xml_col("order", "order")
    wrong = F.when(F.col("k") % 20 == 3, F.replace(doc, F.lit("</status>"), F.lit("</state>"))).otherwise(doc)
    path = f"{run_dir(spark, 's1')}/orders"
    nested_orders(spark, sf).select(F.regexp_replace(wrong, r"\s*\n\s*", "").alias("value")).write.text(path)
    read = D.read_document_lines(spark, path, ORDER)
    corrupt = F.col(D.CORRUPT).isNotNull()
    key = F.when(corrupt, F.regexp_extract(D.CORRUPT, "<order_id>([0-9]+)<", 1)).otherwise(F.col("order_id")).cast("long")
    units = F.aggregate(F.coalesce("line", F.array().cast("array<struct<sku:string,qty:string>>")), F.lit(0).cast("long"), lambda a, l: a + l["qty"].try_cast("long"))
    lines = F.greatest(F.coalesce(F.size("line"), F.lit(0)), F.lit(0)).cast("long")
    whole = lambda c: F.when(~corrupt, c)
    return read.select(key.alias("k"), corrupt.alias("corrupt"), whole(F.col("status")).alias("status"), whole(lines).alias("lines"), whole(F.when(lines > 0, units)).alias("units"))


@query("S2_quarantine_malformed", """
select o_orderkey as id, 'xml' as format, o_orderkey % 20 = 3 as bad from orders
union all select event_id, 'json', event_id % 9 = 4 from events""")
def quarantine(spark, sf):
    good, bad = D.quarantine_malformed(order_documents(spark, sf), "content")
    xml = good.select(F.col("k").alias("id"), F.lit("xml").alias("format"), F.lit(False).alias("bad")).unionByName(bad.select(F.col("k").alias("id"), F.lit("xml").alias("format"), F.lit(True).alias("bad")))
    events = table(spark, sf, "events").withColumn("props", F.when(F.col("event_id") % 9 == 4, F.substring("props", 1, 4)).otherwise(F.col("props")))
    ok, broken = D.quarantine_malformed(events, "props", "json")
    json = ok.select(F.col("event_id").alias("id"), F.lit("json").alias("format"), F.lit(False).alias("bad")).unionByName(broken.select(F.col("event_id").alias("id"), F.lit("json").alias("format"), F.lit(True).alias("bad")))
    return xml.unionByName(json)


@query("S3_route_by_root", """
select page_id, 'html' as root, 'page' as kind from pages union all select doc_id, case when doc_id % 3 = 0 then 'schema' when doc_id % 3 = 1 then 'rules' else 'note' end,
  case when doc_id % 3 = 0 then 'spec' when doc_id % 3 = 1 then 'rules' else 'other' end from documents""")
def route(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("content"))
    name = F.when(F.col("doc_id") % 3 == 0, "xs:schema").when(F.col("doc_id") % 3 == 1, "rules").otherwise("note")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<?xml version='1.0'?><!-- <a> --><"), name, F.lit(" id='1'>"), F.md5("text"), F.lit("</"), name, F.lit(">")).alias("content"))
    return D.route_by_root(pages.unionByName(docs), "content", {"html": "page", "schema": "spec", "rules": "rules"}).select("page_id", "root", "kind")


XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="order"><xs:complexType><xs:sequence>
<xs:element name="order_id" type="xs:long"/><xs:element name="status"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="O"/><xs:enumeration value="F"/></xs:restriction></xs:simpleType></xs:element>
<xs:element name="line" minOccurs="0" maxOccurs="2"><xs:complexType><xs:sequence><xs:element name="sku" type="xs:string"/><xs:element name="qty" type="xs:nonNegativeInteger"/></xs:sequence></xs:complexType></xs:element>
</xs:sequence></xs:complexType></xs:element></xs:schema>"""


@query("S4_read_xsd_gated", "select o_orderstatus in ('O', 'F') and o_custkey % 4 <= 2 as valid, count(*) as documents from orders group by 1")
def gated(spark, sf):
    """Orders written as XML files and read back through an XML schema."""
    import os
    import tempfile
    from plumbline.streaming.monitor import run_dir
    path = os.path.join(run_dir(spark, "xml"), "orders")
    D.write_documents(nested_orders(spark, sf).select("order.*"), path, "orders", "order")
    schema_file = tempfile.NamedTemporaryFile("w", suffix=".xsd", delete=False)  # a spec; shipped with the job
    with schema_file:
        schema_file.write(XSD)
    read = D.read_xsd_gated(spark, path, "order", ORDER, schema_file.name)
    return read.groupBy("valid").agg(F.count(F.lit(1)).alias("documents"))


@query("S5_to_xml", LINES + """
select o_orderkey as k, '<order><order_id>' || o_orderkey || '</order_id><status>' || o_orderstatus || '</status>' || coalesce(x, '') || '</order>' as content from orders left join (
  select k, string_agg('<line><sku>' || sku || '</sku><qty>' || qty || '</qty></line>', '' order by i) as x from l group by 1) on k = o_orderkey""")
def write(spark, sf):
    return nested_orders(spark, sf).select("k", D.to_xml_col("order", "order").alias("content"))


@query("S6_findings_partitions", """
select source, severity, count(*) as findings from (select 'well-formedness' as source, 'error' as severity from orders where o_orderkey % 20 = 3
  union all select 'schema', 'error' from orders where o_orderstatus <> 'O') group by all""")
def written(spark, sf):
    """Findings written by source and severity, and read back from the partitioned table."""
    import os
    from plumbline.functions.types import builtin
    from plumbline.operators.check import check_column
    from plumbline.operators.findings import union_findings, write_findings
    from plumbline.streaming.monitor import run_dir
    _, bad = D.quarantine_malformed(order_documents(spark, sf), "content")
    status = check_column(table(spark, sf, "orders"), "o_orderstatus", builtin("token", enumeration=["O"]), ["o_orderkey"])
    path = os.path.join(run_dir(spark, "findings"), "table")
    write_findings(union_findings(D.malformed_findings(bad, "content", ["k"]), status), path)
    return spark.read.parquet(path).groupBy("source", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query("P1_shred", LINES + """
select k, path, parent_path, name, cast(ordinal as integer) as ordinal, depth, value from (
  select o_orderkey as k, '/order' as path, '' as parent_path, 'order' as name, 1 as ordinal, 1 as depth, null as value from orders
  union all select o_orderkey, '/order/order_id', '/order', 'order_id', 1, 2, cast(o_orderkey as varchar) from orders
  union all select o_orderkey, '/order/status', '/order', 'status', 1, 2, o_orderstatus from orders
  union all select k, '/order/line', '/order', 'line', i, 2, null from l
  union all select k, '/order/line/sku', '/order/line', 'sku', 1, 3, sku from l union all select k, '/order/line/qty', '/order/line', 'qty', 1, 3, cast(qty as varchar) from l)""")
def shred(spark, sf):
    return S.shred(nested_orders(spark, sf), "order", ["k"]).select("k", "path", "parent_path", "name", "ordinal", "depth", "value")


@query("P2_attributes", """
select o_orderkey as k, 'id' as attribute, cast(o_orderkey as varchar) as value from orders union all select o_orderkey, 'status', o_orderstatus from orders where o_orderkey % 3 <> 0""")
def attributes(spark, sf):
    record = F.struct(F.col("o_orderkey").cast("string").alias("_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("_status"),
                      F.lit("urn:o").alias("_xmlns"), F.lit("urn:x").alias("_xmlns:x"), F.col("o_orderpriority").alias("_VALUE"))
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), record.alias("order"))
    return S.attributes(S.shred(df, "order", ["k"]), ["k"]).select("k", "attribute", "value")


@query("P3_text_of", "select conv_id, cast(0 as integer) as part, md5(string_agg(text, '' order by turn)) as digest from conversations group by conv_id")
def text(spark, sf):
    return S.text_of(table(spark, sf, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "part", F.md5("text").alias("digest"))


@query("P4_largest_repeated_group", """
with c as (select user_id, event_type, count(*) as n, min(ts) as first from events group by all having count(*) >= 2)
select user_id, event_type, n as rows from (select *, row_number() over (partition by user_id order by n desc, first) as rn from c) where rn = 1""")
def largest(spark, sf):
    return S.largest_repeated_group(table(spark, sf, "events"), ["user_id"], "event_type", "ts")


@query("P5_repeated_to_table", """
select o_orderkey as k, cast(o_orderkey as varchar) as "@id", o_orderstatus as status, case when o_orderkey % 2 = 0 then o_orderpriority end as priority from orders""")
def wide(spark, sf):
    cells = F.array(F.struct(F.lit("@id").alias("name"), F.col("o_orderkey").cast("string").alias("value")), F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("value")),
                    F.struct(F.when(F.col("o_orderkey") % 2 == 0, "priority").otherwise("status").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("value")))
    return S.repeated_to_table(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.inline(cells)), ["k"], "name", "value")


@query("P6_outline", """
select event_id, row_number() over (partition by user_id, event_type order by ts) as ordinal, count(*) over (partition by user_id, event_type) as siblings from events""")
def outline(spark, sf):
    return S.outline(table(spark, sf, "events"), ["user_id"], "event_type", "ts").select("event_id", "ordinal", "siblings")


@query("P7_document_order", LINES + """
, n as (select o_orderkey as k, '0000000001' as order_key from orders union all select o_orderkey, '0000000001.0000000001.0000000001' from orders union all select o_orderkey, '0000000001.0000000002.0000000001' from orders
  union all select k, '0000000001.0000000003.' || lpad(cast(i as varchar), 10, '0') || s from l, (values (''), ('.0000000001.0000000001'), ('.0000000002.0000000001')) v(s))
select k, order_key, cast(row_number() over (partition by k order by order_key) - 1 as integer) as node_ix from n""")
def order(spark, sf):
    return S.document_order(S.shred(nested_orders(spark, sf), "order", ["k"])).select("k", "order_key", "node_ix")


@query("P8_is_mixed", r"""
with parts as (select page_id, unnest(regexp_extract_all(html, '<[^>]*>|[^<]+')) as p from pages)
select page_id, bool_or(not starts_with(p, '<') and regexp_matches(p, '\S')) and bool_or(starts_with(p, '<')) as mixed from parts group by page_id""")
def mixed(spark, sf):
    parts = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<[^>]*>|[^<]+"), F.lit(0))).alias("p"))
    return S.is_mixed(parts, ["page_id"], ~F.col("p").startswith("<"), "p")
