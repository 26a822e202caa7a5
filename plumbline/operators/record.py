"""Record-shape checks: which fields and children a record has, and whether it may have them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.guarded import Scope
from plumbline.functions.types import SimpleType, problems
from plumbline.operators.check import plausible_name
from plumbline.operators.findings import doc_text, finding, key_text, with_doc
from plumbline.plans.ordered import row_numbers
from plumbline.plans.skew import skew_join


def required_fields(df: DataFrame, cols: Sequence[str], key: Sequence[str], doc: str | None = None) -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    any_missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    rows = df.where(any_missing).select(*with_doc(key, doc), F.explode(missing).alias("_c"))
    return rows.select(*finding(source="schema", severity="error", code="cvc-complex-type.4", doc_key=doc_text(doc), row_key=key_text(*key),
                                anchor="attribute", column=F.col("_c"), message=F.concat(F.col("_c"), F.lit(" is required"))))


def unexpected_fields(df: DataFrame, fields: Column, declared: Sequence[str], key: Sequence[str],
                      wildcard: Column | None = None, doc: str | None = None) -> DataFrame:
    """Undeclared field names of each row (`fields` is an array of names). `wildcard` is a predicate
    over the name column `_c` that admits undeclared names."""
    extra = df.select(*with_doc(key, doc), F.explode(F.array_except(fields, F.array(*map(F.lit, declared)))).alias("_c"))
    if wildcard is not None:
        extra = extra.where(~F.coalesce(wildcard, F.lit(False)))
    near = plausible_name(F.col("_c"), declared)
    fix = lambda title, value: F.struct(title.alias("title"), value.alias("value"), F.lit(False).alias("speculative"))
    fixes = F.array_compact(F.array(
        F.when(near.isNotNull(), fix(F.concat(F.lit("Rename to "), near), near)),
        fix(F.concat(F.lit("Remove "), F.col("_c")), F.lit(None).cast("string"))))
    return extra.select(*finding(source="schema", severity="error", code="cvc-complex-type.3.2.2", doc_key=doc_text(doc), row_key=key_text(*key),
                                 anchor="attribute", column=F.col("_c"), fixes=fixes,
                                 message=F.concat(F.col("_c"), F.lit(" is not a declared field"))))


def unexpected_columns(df: DataFrame, declared: Sequence[str]) -> list[str]:
    """The same for the columns of a table: a schema question, answered without reading rows."""
    return [c for c in df.columns if c not in set(declared)]


def field_status(df: DataFrame, spec: dict[str, dict], key: Sequence[str]) -> DataFrame:
    """Every declared field of every row with its state: required first, then present, then absent.

    spec: {field: {"type": SimpleType, "required": bool}}.
    """
    rows = []
    for position, (c, s) in enumerate(spec.items()):
        value = F.col(c).cast("string")
        found = problems(value, s["type"]) if s.get("type") else F.array().cast("array<struct<code:string,message:string>>")
        rank = F.lit(0) if s.get("required") else F.when(value.isNotNull(), 1).otherwise(2)
        rows.append(F.struct(rank.alias("rank"), F.lit(position).alias("position"), F.lit(c).alias("field"),
                             value.isNotNull().alias("present"), value.alias("value"), F.size(found).alias("problems")))
    ordered = F.array_sort(F.array(*rows), lambda a, b: F.when(a["rank"] != b["rank"], a["rank"] - b["rank"]).otherwise(a["position"] - b["position"]))
    return df.select(*key, F.posexplode(ordered).alias("place", "_f")).select(
        *key, F.col("place"), "_f.field", "_f.present", "_f.value", "_f.problems")


def empty_content(parents: DataFrame, children: DataFrame, keys: Sequence[str], doc: str | None = None) -> DataFrame:
    """Parents declared empty that have children. The child side is reduced to its keys first."""
    rows = parents.join(children.select(*keys).distinct(), list(keys), "left_semi")
    return rows.select(*finding(source="schema", severity="error", code="cvc-complex-type.2.1", doc_key=doc_text(doc), row_key=key_text(*keys),
                                anchor="element", message="nothing may be inside this record"))


def text_not_allowed(nodes: DataFrame, element_only: Column, text: str, key: Sequence[str], doc: str | None = None) -> DataFrame:
    """Non-blank text of its own in a record that may only hold other records."""
    rows = nodes.where(element_only & F.col(text).rlike(r"\S"))
    return rows.select(*finding(source="schema", severity="error", code="cvc-complex-type.2.3", doc_key=doc_text(doc), row_key=key_text(*key),
                                anchor="text", column=text, message="holds other records, so it cannot carry text",
                                technical=F.substring(F.trim(F.col(text)), 1, 60)))


def undeclared(df: DataFrame, name: str, declared: Sequence[tuple[str | None, str]], key: Sequence[str],
               namespace: str | None = None, doc: str | None = None) -> DataFrame:
    """Records of an undeclared type. The right name in the wrong namespace has its own code.

    `declared` lists (namespace, name). Names are judged once per distinct value pair.
    """
    ns = F.col(namespace) if namespace else F.lit(None).cast("string")
    pairs = F.array(*[F.struct(F.coalesce(F.lit(n), F.lit("")).alias("n"), F.lit(l).alias("l")) for n, l in declared])
    here = F.struct(F.coalesce(ns, F.lit("")).alias("n"), F.col(name).alias("l"))
    rows = df.where(F.col(name).isNotNull() & ~F.array_contains(pairs, here))
    homes = F.filter(pairs, lambda p: p["l"] == F.col(name))
    elsewhere = F.size(homes) > 0
    home = F.coalesce(F.nullif(F.get(homes, F.lit(0))["n"], F.lit("")), F.lit("no namespace"))
    near = plausible_name(F.col(name), [l for _, l in declared])
    message = (F.when(elsewhere, F.concat(F.col(name), F.lit(" is declared in "), home))
               .otherwise(F.concat(F.col(name), F.lit(" is not declared"))))
    fix = F.when(~elsewhere & near.isNotNull(), F.array(F.struct(
        F.concat(F.lit("Did you mean "), near, F.lit("?")).alias("title"), near.alias("value"), F.lit(False).alias("speculative"))))
    return rows.select(*finding(source="schema", severity="error", code=F.when(elsewhere, "namespace-mismatch").otherwise("cvc-elt.1"),
                                doc_key=doc_text(doc), row_key=key_text(*key), anchor="element", column=name, message=message, fixes=fix))


def abstract_used(df: DataFrame, name: str, substitutes: dict[str, Sequence[str]], key: Sequence[str], doc: str | None = None) -> DataFrame:
    """Records that use an abstract type; the types that may stand in for it are offered."""
    table = F.create_map(*[x for n, subs in substitutes.items() for x in (F.lit(n), F.array(*map(F.lit, subs)).cast("array<string>"))])
    rows = df.where(F.col(name).isin(*substitutes))
    subs = F.try_element_at(table, F.col(name))
    fixes = F.transform(subs, lambda s: F.struct(F.concat(F.lit("Use "), s).alias("title"), s.alias("value"), F.lit(False).alias("speculative")))
    return rows.select(*finding(source="schema", severity="error", code="cvc-elt.2", doc_key=doc_text(doc), row_key=key_text(*key), anchor="element",
                                column=name, message=F.concat(F.col(name), F.lit(" is abstract")), fixes=fixes))


def select_type(df: DataFrame, alternatives: Sequence[tuple[str | None, str]], default: str, out: str = "type") -> DataFrame:
    """Conditional type: the first test that holds wins, an untested alternative is the fallback,
    and a test that cannot be evaluated is skipped."""
    chosen, fallback, scope = None, F.lit(default), Scope(df)
    for test, name in alternatives:
        if test is None:
            fallback = F.lit(name)
            break
        if scope.broken(test):
            continue
        holds = scope.holds(test)
        chosen = F.when(holds, name) if chosen is None else chosen.when(holds, name)
    return df.withColumn(out, fallback if chosen is None else chosen.otherwise(fallback))


def type_override(df: DataFrame, tag: str, declared: str, known: dict[str, str], out: str = "type") -> DataFrame:
    """An explicit per-row type wins when it names a known type; otherwise the declared one stays."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.trim(F.col(tag))), F.col(declared)))


def assert_record(df: DataFrame, test: str, key: Sequence[str], message: str | None = None, doc: str | None = None) -> DataFrame:
    """A row-level rule over the row's own fields. A rule that cannot be evaluated, at all or on some
    rows, is a warning about the rule, not a finding about the rows."""
    scope = Scope(df)
    if scope.broken(test):
        one = df.sparkSession.range(1)
        return one.select(*finding(source="schema", severity="warning", code="schema-assert-broken", anchor="element",
                                   message=f"the rule cannot be evaluated: {test}", technical=test))
    failed = scope.failed(test)
    said = F.concat(F.lit("the rule cannot be evaluated on "), F.col("_n").cast("string"), F.lit(f" rows: {test}"))
    on_rows = df.where(failed).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select(*finding(
        source="schema", severity="warning", code="schema-assert-broken", anchor="element", message=said, technical=test))
    found = df.where(scope.unmet(test)).select(*finding(
        source="schema", severity="error", code="cvc-assertion-valid", doc_key=doc_text(doc), row_key=key_text(*key), anchor="element",
        message=message or f"breaks the rule: {test}", technical=test))
    return found.unionByName(on_rows) if scope.guard(test).flags else found


def bounds_table(spec: dict[str, tuple[int, int | None]]) -> Column:
    """An occurrence spec {name: (min, max or None)} as an array literal."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(lo).alias("min"), F.lit(hi).cast("int").alias("max"))
                     for i, (n, (lo, hi)) in enumerate(spec.items())])


def cardinality(parents: DataFrame, children: DataFrame, keys: Sequence[str], name: str,
                spec: dict[str, tuple[int, int | None]]) -> DataFrame:
    """Present count against the allowed range, per parent and declared name."""
    counts = (children.where(F.col(name).isin(*spec)).groupBy(*keys, F.col(name).alias("name"))
              .agg(F.count(F.lit(1)).alias("present")))
    wanted = parents.select(*keys, F.inline(bounds_table(spec)))
    out = wanted.join(counts, [*keys, "name"], "left").withColumn("present", F.coalesce("present", F.lit(0)).cast("long"))
    return out.select(*keys, "name", "present", "min", "max",
                      chip(F.col("min"), F.col("max"), F.col("present")).alias("chip"),
                      F.when(F.col("present") < F.col("min"), "too few").when(F.col("present") > F.col("max"), "too many").otherwise("ok").alias("state"))


def chip(low: Column, high: Column, present: Column) -> Column:
    """Fixed format: "2 of 1–3", "2 of 1+", "0 of 1"."""
    bound = (F.when(low == high, low.cast("string")).when(high.isNull(), F.concat(low.cast("string"), F.lit("+")))
             .otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string"))))
    return F.concat(present.cast("string"), F.lit(" of "), bound)


def unordered_members(parents: DataFrame, children: DataFrame, keys: Sequence[str], name: str, order: str,
                      spec: dict[str, tuple[int, int | None]], wildcard: Column | None = None, doc: str | None = None) -> DataFrame:
    """Order-free content: strangers, surplus members and missing members.

    Surplus rows are numbered only for the (parent, name) pairs whose count is over the limit.
    """
    table = bounds_table(spec)
    bound = lambda n: F.get(F.filter(table, lambda b: b["name"] == n), F.lit(0))
    stranger = ~F.col(name).isin(*spec)
    admitted = F.coalesce(wildcard, F.lit(False)) if wildcard is not None else F.lit(False)
    row = lambda code, message: finding(source="schema", severity="error", code=code, doc_key=doc_text(doc or keys), row_key=key_text(*keys, order), anchor="element", column=F.col(name), message=message)
    unknown = children.where(stranger & ~admitted).select(*row("cvc-complex-type.2.4.d", F.concat(F.col(name), F.lit(" is not allowed here"))))
    counts = children.where(~stranger).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n"))
    over = counts.where(F.col("_n") > bound(F.col(name))["max"]).select(*keys, name)
    surplus = row_numbers(skew_join(children, over, [*keys, name], "left_semi"), [*keys, name], order, "_rn")
    surplus = surplus.where(F.col("_rn") > bound(F.col(name))["max"]).select(
        *row("cvc-complex-type.2.4.b", F.concat(F.lit("at most "), bound(F.col(name))["max"].cast("string"), F.lit(" of "), F.col(name))))
    lacking = cardinality(parents, children, keys, name, spec).where("state = 'too few'").select(*finding(
        source="schema", severity="error", code="cvc-complex-type.2.4.b", doc_key=doc_text(doc or keys), row_key=key_text(*keys),
        anchor="childGap", column=F.col("name"),
        message=F.concat(F.lit("needs "), (F.col("min") - F.col("present")).cast("string"), F.lit(" more "), F.col("name"))))
    return unknown.unionByName(surplus).unionByName(lacking)


def open_content(children: DataFrame, keys: Sequence[str], order: str, matches: Column, mode: str) -> DataFrame:
    """Children left for the model after an open wildcard took its share: every match (interleave),
    or only the trailing run of matches (suffix)."""
    hit = F.coalesce(matches, F.lit(False))
    if mode == "interleave":
        return children.where(~hit)
    if mode != "suffix":
        raise ValueError("mode is interleave or suffix")
    last = children.where(~hit).groupBy(*keys).agg(F.max(order).alias("_last"))
    return skew_join(children, last, keys).where(F.col(order) <= F.col("_last")).drop("_last")


def namespace_allowed(col: Column, constraint: str | Sequence[str | None], target: str | None = None) -> Column:
    """"any"; "other" (a namespace, but not the target one); or a list in which None means none."""
    if constraint == "any":
        return F.lit(True)
    if constraint == "other":
        return col.isNotNull() & ~col.eqNullSafe(F.lit(target))
    return reduce(lambda a, b: a | b, [col.eqNullSafe(F.lit(c)) for c in constraint], F.lit(False))


def missing_count(parents: DataFrame, fields: Sequence[str], missing_children: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required fields absent plus required children absent (`missing_children`: keys, missing)."""
    own = reduce(lambda a, b: a + b, [F.col(f).isNull().cast("long") for f in fields], F.lit(0).cast("long"))
    out = parents.select(*keys, own.alias("_own")).join(missing_children.select(*keys, "missing"), list(keys), "left")
    return out.select(*keys, (F.col("_own") + F.coalesce("missing", F.lit(0))).alias("missing"))


def nil_rule(df: DataFrame, flag: Column, content: str, key: Sequence[str], nillable: Column | None = None, doc: str | None = None) -> DataFrame:
    """A row flagged as having no value must have none, and may carry the flag only where allowed."""
    may = F.lit(True) if nillable is None else nillable
    code = F.when(flag & ~may, "cvc-elt.3.1").when(flag & F.col(content).isNotNull(), "cvc-elt.3.2.1")
    return df.withColumn("_code", code).where("_code is not null").select(*finding(
        source="schema", severity="error", code=F.col("_code"), doc_key=doc_text(doc), row_key=key_text(*key), anchor="element", column=content,
        message=F.when(F.col("_code") == "cvc-elt.3.1", "this record may not be flagged empty").otherwise("flagged empty but has a value")))
