"""Keys, references, lookups, definitions and comparisons between tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.guarded import Scope
from plumbline.operators.findings import doc_text, finding, key_text, with_doc
from plumbline.plans.skew import skew_join


def _present(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def duplicate_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Key values used more than once (NULL in any part means no key), with their row counts."""
    return (df.where(_present(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))


def unique(df: DataFrame, cols: Sequence[str], row_key: Sequence[str] | None = None, code: str = "cvc-identity-constraint.4.1", doc: str | None = None) -> DataFrame:
    """Every row whose key another row also has."""
    rows = skew_join(df, duplicate_keys(df, cols), cols)
    return rows.select(*finding(source="schema", severity="error", code=code, doc_key=doc_text(doc), row_key=key_text(*(row_key or cols)), anchor="element",
                                column=",".join(cols), message=F.concat(F.col("rows").cast("string"), F.lit(" rows share this key"))))


def key(df: DataFrame, cols: Sequence[str], row_key: Sequence[str] | None = None, doc: str | None = None) -> DataFrame:
    """Unique, and no part missing."""
    absent = df.where(~_present(cols)).select(*finding(
        source="schema", severity="error", code="cvc-identity-constraint.4.2.1", doc_key=doc_text(doc), row_key=key_text(*(row_key or cols)),
        anchor="element", column=",".join(cols), message="a part of the key is missing"))
    return unique(df, cols, row_key, "cvc-identity-constraint.4.2.2", doc).unionByName(absent)


def dangling(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows whose complete reference names no parent row.

    References are reduced to distinct values before they meet the parents, so a reference shared by
    a third of the rows is looked up once; only values that dangle come back to the rows.
    """
    refs = list(on)
    wanted = child.where(_present(refs)).select(*refs).distinct()
    known = parent.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    bad = wanted.join(known, refs, "left_anti")
    return skew_join(child, bad, refs, "left_semi")


def keyref(child: DataFrame, parent: DataFrame, on: dict[str, str], row_key: Sequence[str], doc: str | None = None) -> DataFrame:
    return dangling(child, parent, on).select(*finding(
        source="schema", severity="error", code="cvc-identity-constraint.4.3", doc_key=doc_text(doc), row_key=key_text(*row_key), anchor="element",
        column=",".join(on), message=F.concat(F.lit("no record is called "), key_text(*on))))


def id_unique(df: DataFrame, doc: str, ident: str) -> DataFrame:
    """Identifiers repeated inside one document."""
    return duplicate_keys(df, [doc, ident])


def idref_resolves(refs: DataFrame, ids: DataFrame, doc: str, ref: str, ident: str) -> DataFrame:
    """References (space-separated lists allowed) that resolve to no identifier of the same document."""
    each = refs.withColumn("_ref", F.explode(F.filter(F.split(F.trim(F.col(ref)), r"\s+"), lambda x: x != "")))
    return dangling(each, ids, {doc: doc, "_ref": ident}).withColumnRenamed("_ref", "missing")


def lookup_rule(df: DataFrame, tables: dict[str, DataFrame], side: str, on: dict[str, str], test: str, row_key: Sequence[str],
                message: str, doc: str | None = None) -> DataFrame:
    """A rule that reads another table; findings stay on the driving row, one for each row_key none of whose side rows meets
    the test; where it cannot be evaluated on one of them, the row is left out. Columns of the side table are written `side.column`. An unknown side table is an error at once."""
    if side not in tables:
        raise KeyError(f"the rule reads table {side}, which is not available; known: {sorted(tables)}")
    right = tables[side]
    names = list(on)
    boxed = right.select(*[F.col(p).alias(c) for c, p in on.items()], F.struct(*right.columns).alias(side))
    sides = skew_join(df, boxed, names, "left")
    scope = Scope(sides)
    met = sides.groupBy(*with_doc(row_key, doc)).agg(F.max(scope.holds(test)).alias("_met"), F.max(scope.failed(test)).alias("_failed"))
    rows = met.where(~F.col("_met") & ~F.col("_failed"))
    return rows.select(*finding(source="rules", severity="error", code="assert", doc_key=doc_text(doc), row_key=key_text(*row_key), anchor="element", message=message, technical=test))


def verdict_drift(a: DataFrame, b: DataFrame, keys: Sequence[str], verdict: str = "valid") -> DataFrame:
    """Documents two engines disagree about, in either direction; an unchecked side is NULL."""
    left = a.select(*keys, F.col(verdict).alias("first"))
    right = b.select(*keys, F.col(verdict).alias("second"))
    out = left.join(right, list(keys), "full_outer").where(~F.col("first").eqNullSafe(F.col("second")))
    kind = (F.when(F.col("first").isNull(), "only second").when(F.col("second").isNull(), "only first")
            .when(F.col("first"), "first accepts").otherwise("second accepts"))
    return out.withColumn("drift", kind)


def dangling_refs(refs: DataFrame, defs: DataFrame, external: Sequence[str] = ()) -> DataFrame:
    """References (space, namespace?, name) to names not defined in their own symbol space; spaces
    with external sources stay quiet. A missing namespace counts as the empty one."""
    cols = [c for c in ("space", "namespace", "name") if c in refs.columns]
    fill = lambda d: d.withColumn("namespace", F.coalesce("namespace", F.lit(""))) if "namespace" in cols else d
    quiet = fill(refs).where(~F.col("space").isin(*external)) if external else fill(refs)
    return dangling(quiet, fill(defs), {c: c for c in cols})


def duplicate_defs(defs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Definitions of a name already defined, each naming the first one. `order` is unique."""
    firsts = defs.groupBy(*keys).agg(F.min(order).alias("first_defined"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return skew_join(defs, firsts, keys).where(F.col(order) > F.col("first_defined"))


def references_to(refs: DataFrame, defs: DataFrame, on: dict[str, str], out: str = "uses") -> DataFrame:
    """How often each definition is used, zero included; counted before joining."""
    names = list(on)
    counts = refs.groupBy(*[F.col(r).alias(d) for d, r in on.items()]).agg(F.count(F.lit(1)).alias(out))
    return defs.join(counts, names, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def overlay(base: DataFrame, own: DataFrame, key: str, prohibited: str | None = None) -> DataFrame:
    """Inherited rows, replaced by own rows of the same name; a row marked prohibited removes it."""
    cols = [c for c in base.columns if c != key]
    left = base.select(key, F.struct(*cols).alias("_b"))
    gone = F.coalesce(F.col(prohibited).cast("boolean"), F.lit(False)) if prohibited else F.lit(False)
    right = own.select(key, F.struct(*cols).alias("_o"), gone.alias("_gone"))
    out = left.join(right, key, "full_outer").where(~F.coalesce("_gone", F.lit(False)))
    picked = F.coalesce("_o", "_b")
    return out.select(key, *[picked[c].alias(c) for c in cols], F.col("_o").isNotNull().alias("own"))


def patch_without_target(patches: DataFrame, base: DataFrame, key: str, doc: str | None = None) -> DataFrame:
    """Patches of names that do not exist."""
    return dangling(patches, base, {key: key}).select(*finding(
        source="schema-health", severity="error", code="redefine-missing-target", doc_key=doc_text(doc), row_key=key_text(key), column=key,
        message=F.concat(F.col(key).cast("string"), F.lit(" does not exist, so it cannot be changed"))))
