"""Keys, references, axes and graphs."""

from pyspark.sql import functions as F

from plumbline.catalog import base, query, table, with_base
from plumbline.operators import axes as X
from plumbline.operators import check as C
from plumbline.operators import graph as G
from plumbline.operators import keys as K
from plumbline.operators import vocabulary as V
from plumbline.plans.ordered import positions

SKEWED = "case when l_partkey % 3 = 0 then 7 else l_orderkey end"


@query("J1_unique", """
select l_orderkey || '|' || l_linenumber as row_key, n || ' rows share this key' as message
from lineitem join (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1) using (l_orderkey, l_linenumber)""")
def unique(spark, sf):
    return K.unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select("row_key", "message")


@query("J2_key", """
with o as (select o_orderkey, case when o_orderkey % 50 = 0 then null when o_orderkey % 60 = 7 then o_orderkey - 1 else o_orderkey end as k from orders)
select cast(o_orderkey as varchar) as row_key, 'cvc-identity-constraint.4.2.1' as code from o where k is null
union all select cast(o_orderkey as varchar), 'cvc-identity-constraint.4.2.2' from o where k in (select k from o where k is not null group by k having count(*) > 1)""")
def key(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", "case when o_orderkey % 50 = 0 then null when o_orderkey % 60 = 7 then o_orderkey - 1 else o_orderkey end as k")
    return K.key(df, ["k"], ["o_orderkey"]).select("row_key", "code")


@query("J3_keyref", """
with l as (select l_orderkey, l_linenumber, case when l_partkey % 3 = 0 then -7 when l_partkey % 31 = 0 then null else l_orderkey + l_partkey % 2 * 5 end as ref from lineitem)
select l_orderkey || '|' || l_linenumber as row_key from l where ref is not null and not exists (select 1 from orders where o_orderkey = ref)""")
def keyref(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("ref", F.expr("case when l_partkey % 3 = 0 then -7 when l_partkey % 31 = 0 then null else l_orderkey + l_partkey % 2 * 5 end"))
    return K.keyref(lines, table(spark, sf, "orders"), {"ref": "o_orderkey"}, ["l_orderkey", "l_linenumber"]).select("row_key")


@query("J4_id_unique_and_idref", """
with t as (select conv_id, turn, 'n' || (turn - turn % 3 // 2) as ident, case when turn > 1 then 'n' || (turn - 1) || '  n' || (turn + 4) else '' end as refs from conversations)
select conv_id, ident as name, 'duplicate' as problem from t group by conv_id, ident having count(*) > 1
union all select conv_id, r, 'unresolved' from (select conv_id, turn, unnest(string_split(refs, '  ')) as r from t where refs <> '') u
where not exists (select 1 from t where t.conv_id = u.conv_id and t.ident = r)""")
def ids(spark, sf):
    t = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "concat('n', turn - (turn % 3) div 2) as ident",
                                                     "case when turn > 1 then concat('n', turn - 1, '  n', turn + 4) else '' end as refs")
    dup = K.id_unique(t, "conv_id", "ident").select("conv_id", F.col("ident").alias("name"), F.lit("duplicate").alias("problem"))
    lost = K.idref_resolves(t, t, "conv_id", "refs", "ident").select("conv_id", F.col("missing").alias("name"), F.lit("unresolved").alias("problem"))
    return dup.unionByName(lost)


@query("J5_lookup_rule", """
select cast(c_custkey as varchar) as row_key from customer left join nation on n_nationkey = c_nationkey
where not coalesce(n_regionkey < 3 or c_acctbal > 0, false)""")
def lookup(spark, sf):
    tables = {"nation": table(spark, sf, "nation")}
    return K.lookup_rule(table(spark, sf, "customer"), tables, "nation", {"c_nationkey": "n_nationkey"},
                         "nation.n_regionkey < 3 or c_acctbal > 0", ["c_custkey"], "a customer in debt must be in a near region").select("row_key")


@query("J6_child_axis", """
select o_orderkey as k, o_orderstatus, l_linenumber, l_partkey from orders join lineitem on l_orderkey = o_orderkey""")
def child(spark, sf):
    orders = table(spark, sf, "orders").selectExpr("o_orderkey as k", "o_orderstatus")
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey as k", "l_linenumber", "l_partkey")
    return X.child_axis(orders, lines, ["k"]).select("k", "o_orderstatus", "l_linenumber", "l_partkey")


def place_nodes(spark, sf):
    """Regions, nations and customers as one tree of paths."""
    region, nation, customer = (table(spark, sf, n) for n in ("region", "nation", "customer"))
    r = region.selectExpr("'world' as doc_id", "concat('/r', r_regionkey) as path", "r_name as name")
    n = nation.selectExpr("'world' as doc_id", "concat('/r', n_regionkey, '/n', n_nationkey) as path", "n_name as name")
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "'world' as doc_id", "concat('/r', n_regionkey, '/n', n_nationkey, '/c', c_custkey) as path", "c_name as name")
    return r.unionByName(n).unionByName(c)


PLACES = """with places as (select '/r' || r_regionkey as path, r_name as name, 1 as depth from region
  union all select '/r' || n_regionkey || '/n' || n_nationkey, n_name, 2 from nation
  union all select '/r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, c_name, 3 from customer join nation on c_nationkey = n_nationkey)
"""


@query("J7_descendant_ancestor", PLACES + """
select p.path, t.path as related, 'below' as axis from places p join places t on starts_with(p.path, t.path || '/') and t.depth = 1
union all select distinct a.path, '', 'above' from places p join places a on starts_with(p.path, a.path || '/') where p.depth = 3 and right(p.path, 1) = '7'""")
def deep(spark, sf):
    nodes = place_nodes(spark, sf)
    tops = nodes.where("path not like '/%/%'")
    below = X.descendant_axis(nodes, "doc_id", "path", tops).select("path", F.col("ancestor").alias("related"), F.lit("below").alias("axis"))
    leaves = nodes.where("path like '/%/%/%7'")
    above = X.ancestor_axis(nodes, "doc_id", "path", leaves).select("path", F.lit("").alias("related"), F.lit("above").alias("axis"))
    return below.unionByName(above)


@query("J8_siblings", """
select conv_id, turn, lag(role) over w as previous, lead(role) over w as following from conversations window w as (partition by conv_id order by turn)""")
def sibling(spark, sf):
    return X.siblings(table(spark, sf, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "previous", "following")


@query("J10_nearest_binding", """
with e as (select user_id, epoch_us(ts) as t, event_id, case when event_type = 'signup' then props when event_type = 'error' then '' end as decl from events),
g as (select *, count(decl) over (partition by user_id order by t) as grp from e)
select event_id, nullif(max(decl) over (partition by user_id, grp), '') as binding from g""")
def binding(spark, sf):
    df = table(spark, sf, "events").withColumn("decl", F.when(F.col("event_type") == "signup", F.col("props")).when(F.col("event_type") == "error", ""))
    return X.binding_as_of(df, ["user_id"], "ts", "decl").select("event_id", "binding")


@query("J10b_nearest_binding_by_path", PLACES + """
select p.path, coalesce((select nullif(arg_max(d.name, d.depth), '') from (select path, case when name like '%3' then '' else name end as name, depth from places where depth < 3) d
  where d.path = p.path or starts_with(p.path, d.path || '/')), null) as binding from places p""")
def path_binding(spark, sf):
    nodes = place_nodes(spark, sf)
    decls = nodes.where("path not like '/%/%/%'").select("doc_id", "path", F.when(F.col("name").endswith("3"), "").otherwise(F.col("name")).alias("value"))
    return X.nearest_binding(nodes, decls).select("path", "binding")


@query("J11_did_you_mean", with_base("event_names") + """
, d as (select unnest(['click', 'view', 'error', 'purchase', 'signup']) as o, unnest([0, 1, 2, 3, 4]) as i),
n as (select distinct name from event_names),
s as (select name, arg_min(o, levenshtein(lower(name), o) * 10 + i) as suggestion from n, d
  where levenshtein(lower(name), o) <= least(3, greatest(1, greatest(length(name), length(o)) // 3)) group by name)
select event_id, name, suggestion from event_names left join s using (name)""")
def suggest(spark, sf):
    return C.did_you_mean(base(spark, sf, "event_names"), "name", ["click", "view", "error", "purchase", "signup"]).select("event_id", "name", "suggestion")


@query("J11b_nearest_word", """
with said as (select unnest(regexp_split_to_array(text, '[^A-Za-z]+')) as word from conversations),
n as (select word, count(*) as uses from said where word <> '' group by word),
v as (select distinct unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as o from benchmark),
r as (select word, o, levenshtein(lower(word), o) as edits from n, v where o <> '' and abs(length(word) - length(o)) <= 3),
b as (select word, arg_min(o, (edits, o)) as suggestion from r where edits <= least(3, greatest(1, greatest(length(word), length(o)) // 3)) group by word)
select word, uses, suggestion from n left join b using (word)""")
def nearest_word(spark, sf):
    """Every word of the conversations and the word of the benchmark nearest to it."""
    split = lambda df, pattern, text: df.select(F.explode(F.split(text, pattern)).alias("word")).where("word <> ''")
    said = split(table(spark, sf, "conversations"), "[^A-Za-z]+", F.col("text")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    listed = split(table(spark, sf, "benchmark"), "[^a-z]+", F.lower("text"))
    return V.suggest(said, "word", V.vocabulary(listed, "word"))


@query("J12_verdict_drift", """
select doc_id, first, second, case when first is null then 'only second' when second is null then 'only first' when first then 'first accepts' else 'second accepts' end as drift
from (select doc_id, quality = 1 as first from labels) full join (select doc_id, n_chars > 900 as second from documents) using (doc_id)
where first is distinct from second""")
def drift(spark, sf):
    a = table(spark, sf, "labels").selectExpr("doc_id", "quality = 1 as valid")
    b = table(spark, sf, "documents").selectExpr("doc_id", "n_chars > 900 as valid")
    return K.verdict_drift(a, b, ["doc_id"])


@query("J13_dangling_refs", """
select space, name, count(*) as uses from (select 'nation' as space, cast(c_nationkey + c_custkey % 3 as varchar) as name from customer
  union all select 'part', cast(l_partkey + 5 as varchar) from lineitem) r
where not exists (select 1 from (select 'nation' as space, cast(n_nationkey as varchar) as name from nation union all select 'part', cast(p_partkey as varchar) from part) d
  where d.space = r.space and d.name = r.name) group by all""")
def dangling(spark, sf):
    refs = (table(spark, sf, "customer").selectExpr("'nation' as space", "cast(c_nationkey + c_custkey % 3 as string) as name")
            .unionByName(table(spark, sf, "lineitem").selectExpr("'part' as space", "cast(l_partkey + 5 as string) as name"))
            .unionByName(table(spark, sf, "orders").selectExpr("'outside' as space", "o_orderstatus as name")))
    defs = (table(spark, sf, "nation").selectExpr("'nation' as space", "cast(n_nationkey as string) as name")
            .unionByName(table(spark, sf, "part").selectExpr("'part' as space", "cast(p_partkey as string) as name")))
    return K.dangling_refs(refs, defs, ["outside"]).groupBy("space", "name").agg(F.count(F.lit(1)).alias("uses"))


@query("J14_duplicate_defs", """
select p_partkey, p_name, first_defined from part join (select p_name, min(p_partkey) as first_defined from part group by p_name) using (p_name) where p_partkey > first_defined""")
def duplicates(spark, sf):
    return K.duplicate_defs(table(spark, sf, "part"), ["p_name"], "p_partkey").select("p_partkey", "p_name", "first_defined")


@query("J15_references_to", "select s_suppkey, count(l_suppkey) as uses from supplier left join lineitem on l_suppkey = s_suppkey group by s_suppkey")
def references(spark, sf):
    return K.references_to(table(spark, sf, "lineitem"), table(spark, sf, "supplier"), {"s_suppkey": "l_suppkey"}).select("s_suppkey", "uses")


def chain_edges(spark, sf):
    """Parts derive from the part with half their number, and every 50th closes a cycle."""
    part = table(spark, sf, "part")
    tree = part.where("p_partkey > 0").selectExpr("p_partkey div 2 as head", "p_partkey as member", "case when p_partkey % 9 = 0 then 'extension' else 'restriction' end as kind")
    loop = part.where("p_partkey % 50 = 49").selectExpr("p_partkey as head", "p_partkey div 8 as member", "'loop' as kind")
    return tree.unionByName(loop)


EDGES = """with recursive e as (select p_partkey // 2 as head, p_partkey as member, case when p_partkey % 9 = 0 then 'extension' else 'restriction' end as kind from part where p_partkey > 0
  union all select p_partkey, p_partkey // 8, 'loop' from part where p_partkey % 50 = 49)"""


@query("J16_closure", EDGES + """
, c as (select head, member from e union select c.head, e.member from c join e on c.member = e.head)
select head, member from c where head <> member and member % 10 <> 0""")
def closure(spark, sf):
    part = table(spark, sf, "part")
    abstract = part.where("p_partkey % 10 = 0").select("p_partkey")
    return G.closure(chain_edges(spark, sf), "head", "member", abstract=abstract).select("head", "member")


CHAIN = """with o as (select o_orderkey as k, lead(o_orderkey) over (order by o_orderkey) as n from orders),
c as (select k, row_number() over (order by k) as i, count(*) over () as n from o)
"""


@query("J16b_closure_chain", CHAIN + """
select (select min(k) from c) as head, k as member, cast(i - 1 as integer) as depth from c where i > 1""")
def closure_chain(spark, sf):
    """One chain through all orders, from its first: as deep as the table is long, in a number of rounds that grows with its logarithm."""
    orders = positions(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "i")
    edges = orders.selectExpr("o_orderkey as head", "i + 1 as i").join(orders.selectExpr("o_orderkey as member", "i"), "i").select("head", "member")
    first = orders.where("i = 1").select("o_orderkey")
    return G.closure(edges, "head", "member", first)


@query("J17_derived_types", EDGES + """
, c as (select member from e where head = 3 and kind not in ('extension', 'loop') union select e.member from c join e on c.member = e.head and e.kind not in ('extension', 'loop'))
select member as name from c""")
def derived(spark, sf):
    edges = chain_edges(spark, sf).selectExpr("member as name", "head as base", "kind")
    return G.derived_types(edges, 3, ["extension", "loop"]).select("name")


@query("J18_include_closure", EDGES + """
, avail as (select p_partkey as doc from part where p_partkey % 17 <> 5),
c as (select 2::bigint as doc union select e.member from c join e on e.head = c.doc join avail a on a.doc = e.head)
select doc, 'reached' as what from c
union all select doc, 'missing' from c where doc not in (select doc from avail)
union all select member, 'conflict' from e join c on c.doc = e.head join avail on avail.doc = e.head group by member having count(distinct kind) > 1""")
def includes(spark, sf):
    edges = chain_edges(spark, sf).selectExpr("head as src", "member as dst", "kind as namespace")
    part = table(spark, sf, "part")
    found = G.include_closure(edges, part.where("p_partkey = 2").selectExpr("p_partkey as doc"), part.where("p_partkey % 17 <> 5").selectExpr("p_partkey as doc"))
    parts = [found[w].select("doc", F.lit(w).alias("what")) for w in ("reached", "missing", "conflict")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("J19_overlay", """
with own as (select c_custkey + 100 as c_custkey, 'OWN' as c_mktsegment, c_custkey % 12 = 0 as gone from customer where c_custkey % 4 = 0)
select coalesce(b.c_custkey, o.c_custkey) as c_custkey, coalesce(o.c_mktsegment, b.c_mktsegment) as c_mktsegment, o.c_custkey is not null as own, false as orphan
from customer b full join own o on b.c_custkey = o.c_custkey where not coalesce(gone, false)
union all select c_custkey, null, true, true from own where c_custkey not in (select c_custkey from customer)""")
def overlay(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    own = customer.where("c_custkey % 4 = 0").selectExpr("c_custkey + 100 as c_custkey", "'OWN' as c_mktsegment", "c_custkey % 12 = 0 as gone")
    merged = K.overlay(customer, own, "c_custkey", "gone").withColumn("orphan", F.lit(False))
    lost = K.patch_without_target(own, customer, "c_custkey").select(
        F.col("row_key").cast("long").alias("c_custkey"), F.lit(None).cast("string").alias("c_mktsegment"), F.lit(True).alias("own"), F.lit(True).alias("orphan"))
    return merged.unionByName(lost)
