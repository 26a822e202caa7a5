"""Profiling a table and inferring a spec from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexical as L
from plumbline.functions import observed
from plumbline.functions.model import allowed_pairs, compile_model
from plumbline.functions.text import humanise
from plumbline.plans.ordered import neighbours
from plumbline.plans.skew import skew_join, top_n_per_group

ENUM_LIMIT = 8   # fixed value: most distinct values of an enumeration
VALUE_CAP = 64   # fixed value: values kept as examples per name


def as_nodes(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Wide rows as (keys, name, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(*keys, F.inline(pairs))


def profile(nodes: DataFrame, name: str = "name", value: str = "value", has_children: str | None = None,
            keys: Sequence[str] = ()) -> DataFrame:
    """Per name: occurrences, has_text, has_children, distinct values, and up to 64 of them (`profile_values` has all).

    Counted per (name, value) first, so neither a frequent name nor a frequent value gathers rows.
    """
    text = F.nullif(F.trim(F.col(value)), F.lit(""))
    kids = F.col(has_children) if has_children else F.lit(False)
    pairs = nodes.groupBy(*keys, F.col(name).alias("name"), text.alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(kids).alias("_kids"))
    stats = pairs.groupBy(*keys, "name").agg(
        F.sum("_n").alias("occurrences"), (F.count("_v") > 0).alias("has_text"), F.bool_or("_kids").alias("has_children"),
        F.count("_v").alias("distinct_values"))
    kept = top_n_per_group(pairs.where("_v is not null").select(*keys, "name", "_v"), [*keys, "name"], [F.col("_v")], VALUE_CAP)
    values = kept.groupBy(*keys, "name").agg(F.array_sort(F.collect_list("_v")).alias("values"))
    return stats.join(values, [*keys, "name"], "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def profile_values(nodes: DataFrame, name: str = "name", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Every distinct value of every name with its count, one row each, so no row grows with the values."""
    text = F.nullif(F.trim(F.col(value)), F.lit(""))
    return nodes.groupBy(*keys, F.col(name).alias("name"), text.alias("value")).agg(F.count(F.lit(1)).alias("occurrences")).where("value is not null")


def infer_occurs(parents: DataFrame, children: DataFrame, keys: Sequence[str], name: str,
                 parent_keys: Sequence[str] | None = None) -> DataFrame:
    """Fewest and most of each child name per parent; absent anywhere means 0, more than one means
    unbounded (NULL)."""
    total = parents.count()
    owned = children.join(parents.select(*[F.col(p).alias(k) for p, k in zip(parent_keys or keys, keys, strict=True)]).distinct(), list(keys), "left_semi")  # a child without a parent says nothing
    counts = owned.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n"))
    per = counts.groupBy(name).agg(F.count(F.lit(1)).alias("_with"), F.min("_n").alias("_min"), F.max("_n").alias("_max"))
    return per.select(name, F.when(F.col("_with") < total, 0).otherwise(F.col("_min")).cast("long").alias("min_occurs"),
                      F.when(F.col("_max") <= 1, F.col("_max")).alias("max_occurs"), F.col("_max").alias("most_seen"))


def infer_required(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Required if and only if present in every row; one pass for all columns."""
    one = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_{i}").alias("present"),
                                                  ((F.col(f"_{i}") == F.col("_all")) & (F.col("_all") > 0)).alias("required")) for i, c in enumerate(cols)])))


def infer_enumeration(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns that look closed: 2 to 8 distinct values, at least one of them repeated.

    A sketch over all columns picks the few worth an exact count; it is near exact at this size, and
    the exact count decides.
    """
    sketch = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    near = [c for i, c in enumerate(cols) if sketch[f"_{i}"] <= 4 * ENUM_LIMIT]
    nodes = as_nodes(df, near or cols[:1]).where("value is not null")
    counts = nodes.groupBy("name", "value").agg(F.count(F.lit(1)).alias("_n"))
    per = counts.groupBy("name").agg(F.count(F.lit(1)).alias("_d"), F.sum("_n").alias("_all"))
    closed = per.where((F.col("_d") > 1) & (F.col("_d") <= ENUM_LIMIT) & (F.col("_all") > F.col("_d"))).select("name")
    listed = counts.join(closed, "name", "left_semi").groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("enumeration"))
    return listed.withColumnRenamed("name", "field")


def content_kind(profiled: DataFrame, attributes: str | None = None) -> DataFrame:
    """simple, simple with attributes, element-only or mixed, from the flags of a profile."""
    attrs = F.col(attributes) if attributes else F.lit(False)
    kind = (F.when(F.col("has_children") & F.col("has_text"), "mixed").when(F.col("has_children"), "element-only")
            .when(attrs, "simple with attributes").otherwise("simple"))
    return profiled.withColumn("content", kind)


def inference_caveats(profiled: DataFrame, namespaces: int = 0) -> DataFrame:
    """What the inference had to guess at, one row per caveat."""
    one = profiled.agg(
        F.count_if(F.col("occurrences") == 1).alias("once"),
        F.count_if(F.col("has_text") & F.col("has_children")).alias("mixed"), F.count(F.lit(1)).alias("names"))
    rows = F.array_compact(F.array(
        F.when(F.lit(namespaces > 0), F.struct(F.lit("namespaces").alias("caveat"), F.lit(namespaces).cast("long").alias("count"))),
        F.when(F.col("once") > 0, F.struct(F.lit("seen once").alias("caveat"), F.col("once").alias("count"))),
        F.when(F.col("mixed") > 0, F.struct(F.lit("mixed content").alias("caveat"), F.col("mixed").alias("count"))),
        F.struct(F.lit("all values typed as text").alias("caveat"), F.col("names").alias("count"))))
    return one.select(F.inline(rows))


# Steps of the type lattice, most specific first.
LATTICE = ("boolean", "integer", "decimal", "date", "dateTime", "uri", "string")


def _fits(col: Column) -> Column:
    """Bit mask of the lattice steps one value satisfies; the cheap and frequent cases come first."""
    bit = {s: 1 << i for i, s in enumerate(LATTICE[:-1])}
    number = bit["integer"] | bit["decimal"]
    return (F.when(col.isNull(), None)
            .when(col.isin("0", "1"), bit["boolean"] | number).when(col.isin("true", "false"), bit["boolean"])
            .when(col.rlike(r"\A[+-]?\d+\z"), number).when(L.is_lexical(col, "decimal"), bit["decimal"])
            .when(col.rlike(r"\A-?\d"), F.when(L.is_lexical(col, "date"), bit["date"]).when(L.is_lexical(col, "dateTime"), bit["dateTime"]).otherwise(0))
            .when(col.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:\S+\z"), bit["uri"]).otherwise(0))


def infer_type_lattice(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most specific type that all present values of each column satisfy; all columns in one pass."""
    one = df.agg(*[F.coalesce(F.bit_and(_fits(F.col(c).cast("string"))), F.lit(0)).alias(f"_{i}") for i, c in enumerate(cols)])
    def pick(i: int) -> Column:
        out = None
        for n, s in enumerate(LATTICE[:-1]):
            has = F.col(f"_{i}").bitwiseAND(1 << n) != 0
            out = F.when(has, s) if out is None else out.when(has, s)
        return out.otherwise("string")
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), pick(i).alias("type")) for i, c in enumerate(cols)])))


def follow_pairs(df: DataFrame, keys: Sequence[str], order: str, symbol: str, chunk_rows: int | None = None) -> DataFrame:
    """How often one symbol follows another inside a group; "^" starts and "$" ends a group."""
    near = neighbours(df.select(*keys, order, symbol), keys, order, symbol, "_p", "_f", chunk_rows)
    pair = lambda a, b: F.struct(a.alias("symbol"), b.alias("next"))
    rows = F.array_compact(F.array(F.when(F.col("_p").isNull(), pair(F.lit("^"), F.col(symbol))),
                                   pair(F.col(symbol), F.coalesce("_f", F.lit("$")))))
    return near.select(F.inline(rows)).groupBy("symbol", "next").agg(F.count(F.lit(1)).alias("times"))


def observed_edges(df: DataFrame, keys: Sequence[str], order: str, symbol: str, chunk_rows: int | None = None) -> DataFrame:
    """(kind, symbol, next, times): symbols that begin a group (kind first), end it (last), or follow one another (pair)."""
    boxed = df.select(*keys, order, F.struct(F.col(symbol).alias("s")).alias("_box"))  # a NULL symbol is not a missing neighbour
    near = neighbours(boxed, keys, order, "_box", "_p", "_f", chunk_rows)
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("symbol"), b.alias("next"))
    none = F.lit(None).cast(df.schema[symbol].dataType)
    rows = F.array_compact(F.array(F.when(F.col("_p").isNull(), edge("first", F.col("_box.s"), none)), F.when(F.col("_f").isNull(), edge("last", F.col("_box.s"), none)),
                                   F.when(F.col("_f").isNotNull(), edge("pair", F.col("_box.s"), F.col("_f.s")))))
    return near.select(F.inline(rows)).groupBy("kind", "symbol", "next").agg(F.count(F.lit(1)).alias("times"))


def observed_model(df: DataFrame, keys: Sequence[str], order: str, symbol: str, chunk_rows: int | None = None):
    """An order model that every group follows, learnt from the pairs of symbols, as an expression for `compile_model`.

    Only the distinct pairs come to the driver, at most the square of `observed.MAX_SYMBOLS`; beyond that it raises."""
    most = (observed.MAX_SYMBOLS + 2) ** 2
    edges = observed_edges(df, keys, order, symbol, chunk_rows).select("kind", "symbol", "next").limit(most + 1).collect()
    if len(edges) > most:
        raise ValueError(f"more than {most} different pairs of symbols")
    of = lambda kind: [(r["symbol"], r["next"]) for r in edges if r["kind"] == kind]
    return observed.learn([a for a, _ in of("first")], [a for a, _ in of("last")], of("pair"))


def model_pairs(df: DataFrame, keys: Sequence[str], order: str, symbol: str, root, chunk_rows: int | None = None) -> DataFrame:
    """(symbol, next, times) for every pair the model allows, with how often it occurs; "^" starts and "$" ends a group."""
    allowed = df.sparkSession.createDataFrame(sorted(tuple(map(str, p)) for p in allowed_pairs(compile_model(root))), "symbol string, next string")
    seen = observed_edges(df, keys, order, symbol, chunk_rows)
    seen = seen.select(F.when(F.col("kind") == "first", "^").otherwise(F.col("symbol").cast("string")).alias("symbol"),
                       F.when(F.col("kind") == "first", F.col("symbol").cast("string")).when(F.col("kind") == "last", "$").otherwise(F.col("next").cast("string")).alias("next"), "times")
    # both sides hold distinct pairs of symbols
    return allowed.join(seen, ["symbol", "next"], "left").select("symbol", "next", F.coalesce("times", F.lit(0)).cast("long").alias("times"))


def infer_from_many(df: DataFrame, doc: str, cols: Sequence[str]) -> DataFrame:
    """A profile over many documents: also in how many of them each name has a value."""
    nodes = as_nodes(df, cols, [doc])
    docs = (nodes.where("value is not null").select(doc, "name").distinct()
            .groupBy("name").agg(F.count(F.lit(1)).alias("documents")))
    stats = profile(nodes).drop("values", "has_children")
    return stats.join(docs, "name", "left").withColumn("documents", F.coalesce("documents", F.lit(0)).cast("long"))


def render_spec(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: inferred type, required flag and enumeration; feeds `spec_from_rows`."""
    types, req, enum = infer_type_lattice(df, cols), infer_required(df, cols), infer_enumeration(df, cols)
    place = F.array_position(F.array(*map(F.lit, cols)), F.col("field"))
    return types.join(req.select("field", "required"), "field").join(enum, "field", "left").withColumn("place", place)


def spec_from_rows(rows: DataFrame) -> dict[str, dict]:
    """The inferred spec as a dict for the checks (one row per column comes to the driver)."""
    from plumbline.functions.types import BUILTINS, derive
    names = {"uri": "anyURI"}
    out = {}
    for r in rows.orderBy("place").toLocalIterator():
        base = BUILTINS[names.get(r["type"], r["type"])]
        out[r["field"]] = {"type": derive(base, enumeration=r["enumeration"]) if r["enumeration"] else base, "required": r["required"]}
    return out


def ddl(rows: DataFrame) -> str:
    sql = {"boolean": "BOOLEAN", "integer": "BIGINT", "decimal": "DECIMAL(38,18)", "date": "DATE", "dateTime": "TIMESTAMP"}
    return ", ".join(f"{r['field']} {sql.get(r['type'], 'STRING')}{' NOT NULL' if r['required'] else ''}" for r in rows.orderBy("place").toLocalIterator())


def top_repeated(df: DataFrame, name: str, k: int = 3) -> DataFrame:
    """The k most frequent names among those that repeat."""
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    return counts.orderBy(F.desc("occurrences"), name).limit(k)


def summary(nodes: DataFrame, name: str = "name", depth: str = "depth", namespace: str | None = None, k: int = 3) -> DataFrame:
    """One row: elements, depth, namespaces and the most repeated names. Reduced to one row per name
    first, and only the k best of those are gathered."""
    ns = F.col(namespace) if namespace else F.lit(None).cast("string")
    pairs = nodes.groupBy(F.col(name).alias("_name"), ns.alias("_ns")).agg(F.count(F.lit(1)).alias("_n"), F.max(depth).alias("_d"))
    totals = pairs.agg(F.sum("_n").alias("elements"), F.max("_d").alias("depth"), F.count_distinct("_ns").alias("namespaces")).withColumn("_one", F.lit(1))
    best = (pairs.groupBy("_name").agg(F.sum("_n").alias("_n")).where("_n > 1").orderBy(F.desc("_n"), "_name").limit(k)
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_name").alias("name")))).alias("_best")).withColumn("_one", F.lit(1)))
    said = F.transform("_best", lambda b: F.concat((-b["n"]).cast("string"), F.lit(" "), F.lower(humanise(b["name"]))))
    return totals.join(best, "_one").select("elements", "depth", "namespaces", F.array_join(said, ", ").alias("mostly"))


def shape_of(children: DataFrame, keys: Sequence[str], name: str, order: str, shown: int = 4) -> DataFrame:
    """"Holds a, 3 b, and 2 more": child names in first-seen order with their counts."""
    per = children.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    kinds = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("kinds"))
    first = top_n_per_group(per, keys, [F.col("_first"), F.col(name)], shown)
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", F.col(name).alias("name"), "_n"))).alias("_l"))
    word = lambda x: F.when(x["_n"] == 1, x["name"].cast("string")).otherwise(F.concat(x["_n"].cast("string"), F.lit(" "), x["name"].cast("string")))
    more = F.when(F.col("kinds") > shown, F.concat(F.lit(", and "), (F.col("kinds") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return kinds.join(listed, list(keys)).select(*keys, F.concat(F.lit("Holds "), F.array_join(F.transform("_l", word), ", "), more, F.lit(".")).alias("shape"))
