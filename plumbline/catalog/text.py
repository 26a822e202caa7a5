"""Scalar functions."""

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.functions import text as X


@query("X1_humanise", """
select p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) as shouted, upper(left(p_name, 1)) || lower(substr(p_name, 2)) as snake, 'XML part size' as camel from part""")
def humanise(spark, sf):
    df = table(spark, sf, "part")
    return df.select("p_partkey", X.humanise(F.col("p_type")).alias("shouted"), X.humanise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("snake"),
                     X.humanise(F.when(F.col("p_partkey") >= 0, "XMLPartSize")).alias("camel"))


@query("X2_decode_entities", """
select page_id, md5(replace(replace(replace(replace(replace(html, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&apos;', ''''), '&amp;', '&')) as digest,
  'A' || chr(cast(200 + page_id as integer)) || '<&lt;&copy;' as numeric_refs from pages""")
def decode(spark, sf):
    refs = F.concat(F.lit("&#65;&#x"), F.lower(F.hex(F.col("page_id") + 200)), F.lit(";&lt;&amp;lt;&copy;"))
    return table(spark, sf, "pages").select("page_id", F.md5(X.decode_entities(F.col("html"))).alias("digest"), X.decode_entities(refs).alias("numeric_refs"))


@query("X3_encode", r"""
select page_id, md5(replace(replace(h, '<', '&lt;'), '>', '&gt;')) as text_digest,
  md5(replace(replace(replace(replace(h, '<', '&lt;'), chr(9), '&#9;'), chr(10), '&#10;'), '"', '&quot;')) as attribute_digest
from (select page_id, replace(replace(regexp_replace(replace(html, 'the ', 'R&D '), '&(#x[0-9a-fA-F]+|#[0-9]+|[A-Za-z_:][A-Za-z0-9_.:-]*);', chr(1) || '\1;', 'g'), '&', '&amp;'), chr(1), '&') as h from pages)""")
def encode(spark, sf):
    html = F.replace("html", F.lit("the "), F.lit("R&D "))
    return table(spark, sf, "pages").select("page_id", F.md5(X.encode_text(html)).alias("text_digest"), F.md5(X.encode_attribute(html)).alias("attribute_digest"))


@query("X4_normalise_attribute", """
select doc_id, md5(replace(replace(replace(replace(text, chr(13) || chr(10), ' '), chr(9), ' '), chr(10), ' '), chr(13), ' ') || '<') as digest from documents""")
def attribute(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.normalise_attribute(F.concat("text", F.lit("&lt;")))).alias("digest"))


@query("X5_valid_name", """
select doc_id, len(words)::bigint as words, len(list_filter(words, lambda w: regexp_full_match(w, '[\\pL_:][\\pL\\pN_:.\\-]*')))::bigint as names
from (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda w: w <> '') as words from documents)""")
def names(spark, sf):
    """How many of a document's words are names."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")
    return table(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.size(F.filter(words, X.valid_name)).cast("long").alias("names"))


@query("X9_resolve_uri", """
select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/img/' || page_id || '.png' as rooted,
  regexp_extract(url, '^[a-z]+://[^/?#]*') || case when contains(regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1), '/') then regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '[^/]*$', '') else '/' end || 'x.css?v=1' as beside, url as same from pages""")
def resolve(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", X.resolve_uri(F.concat(F.lit("/a/../img/./"), F.col("page_id").cast("string"), F.lit(".png")), u).alias("rooted"),
        X.resolve_uri(F.lit("./sub/../x.css?v=1"), u).alias("beside"), X.resolve_uri(u, F.lit("http://other/")).alias("same"))


@query("X11_edit_distance", """
select p_partkey, cast(levenshtein(p_name, p_type) as integer) as distance, cast(case when levenshtein(p_name, 'red widget') > 4 then -1 else levenshtein(p_name, 'red widget') end as integer) as near from part""")
def distance(spark, sf):
    df = table(spark, sf, "part")
    return df.select("p_partkey", X.edit_distance(F.col("p_name"), F.col("p_type")).alias("distance"), X.edit_distance(F.col("p_name"), F.lit("red widget"), 4).alias("near"))


@query("X12_xpath_value", """
select o_orderkey, case when o_orderkey % 4 <> 1 then o_orderstatus end as status, case when o_orderkey % 4 <> 1 then o_custkey % 2 = 0 end as even, case when o_orderkey % 4 <> 1 then 2 end as parts from orders""")
def xpath(spark, sf):
    """Orders written as XML; every fourth is broken and must give NULL."""
    doc = F.concat(F.lit("<order id='"), F.col("o_orderkey").cast("string"), F.lit("'><status>"), F.col("o_orderstatus"), F.lit("</status><customer>"),
                   F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 4 == 1, "</client></order>").otherwise("</customer></order>"))
    found = X.xpath_values(F.col("doc"), {"status": ("/order/status", "string"), "even": ("/order[customer mod 2 = 0]", "boolean"), "parts": ("/order/*/text()", "nodes")})
    df = table(spark, sf, "orders").withColumn("doc", doc).select("o_orderkey", found.alias("x"))
    return df.select("o_orderkey", "x.status", "x.even", F.size("x.parts").alias("parts"))


@query("P9_text_preview", r"""
select doc_id, case when t = '' then null when length(t) > 48 then left(t, 47) || '…' else t end as preview from (select doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') as t from documents)""")
def preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.text_preview(F.col("text")).alias("preview"))


# Piece by piece: what stands between < and > is cut at its blanks; declarations go, names lose what stands before a colon.
@query("P11_strip_namespaces", """
with h as (select page_id, string_split(replace(replace(replace(html, '<li>', '<h:li xmlns:h="urn:h" h:role="item">'), '</li>', '</h:li>'), '<p>', '<x:p>'), '<') as ps from pages),
tags as (select page_id, i, ps[i] as p, case when i > 1 then split_part(ps[i], '>', 1) else '' end as tag from (select page_id, ps, unnest(range(1, len(ps) + 1)) as i from h)),
words as (select page_id, i, p, tag, list_filter(string_split(tag, ' '), lambda w: not starts_with(w, 'xmlns:') and not starts_with(w, 'xmlns=')) as ws from tags),
bare as (select page_id, i, array_to_string(list_transform(ws, lambda w: case when contains(split_part(w, '=', 1), ':')
  then (case when starts_with(w, '/') then '/' else '' end) || substr(w, strpos(w, ':') + 1) else w end), ' ') || substr(p, length(tag) + 1) as piece from words)
select page_id, md5(string_agg(piece, '<' order by i)) as digest from bare group by page_id""")
def strip(spark, sf):
    h = F.replace(F.replace(F.replace("html", F.lit("<li>"), F.lit('<h:li xmlns:h="urn:h" h:role="item">')), F.lit("</li>"), F.lit("</h:li>")), F.lit("<p>"), F.lit("<x:p>"))
    return table(spark, sf, "pages").select("page_id", F.md5(X.strip_namespaces(h)).alias("digest"))
