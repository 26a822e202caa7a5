"""Health of type specs held as rows: any number of types, judged by joins and aggregates.

`types` has (name, base), `facets` has (name, facet, value as text, fixed). A type inherits the facets of all types it is derived from,
the built-in ones included, found by the closure of the derivation edges; the strictest inherited value of each facet is
kept by one aggregate per type and facet. The findings are those of `compile_types`, except that every name on a cycle
is reported. Nothing comes to the driver; the built-in types are a fixed table of their own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.patterns import translate
from plumbline.functions.types import BOUND_WORDS, BUILTINS, SPACE_RANK, readable_bound
from plumbline.operators.findings import finding
from plumbline.operators.graph import all_pairs
from plumbline.plans.lineage import cut
from plumbline.plans.skew import skew_join

COUNTS = ("length", "min_length", "max_length", "total_digits", "fraction_digits")
#: Facets of which the greater value is the stricter one.
RISING = ("min_length", "min_inclusive", "min_exclusive", "white_space")
FREE = ("pattern", "enumeration", "by_value")
SPACES = sorted(SPACE_RANK, key=SPACE_RANK.__getitem__)


def builtin_rows(spark) -> tuple[DataFrame, DataFrame]:
    """(name, base, primitive) and (name, facet, value, fixed) of the built-in types."""
    types, facets = [], []
    for name, t in BUILTINS.items():
        types.append((name, t.ancestry[0] if t.ancestry else None, t.primitive))
        own = [(f, getattr(t, f)) for f in COUNTS if getattr(t, f) is not None] + list(t.bounds) + ([("white_space", t.white_space)] if t.white_space else [])
        facets += [(name, f, str(v), f in t.fixed) for f, v in own]
    return spark.createDataFrame(types, "name string, base string, primitive string"), spark.createDataFrame(facets, "name string, facet string, value string, fixed boolean")


def type_health(types: DataFrame, facets: DataFrame) -> DataFrame:
    """Findings about the spec: source schema-health, rule_id the type."""
    spark = types.sparkSession
    given_types, given_facets = builtin_rows(spark)
    own = cut(types.select("name", "base").distinct())
    names = own.select("name").distinct()
    known = names.unionByName(given_types.select("name")).distinct()
    problem = lambda df, code, name, text: df.select(F.lit(code).alias("code"), name.alias("name"), text.alias("text"))
    found = [problem(types.groupBy("name").count().where("count > 1"), "duplicate-definition", F.col("name"), F.concat(F.col("name"), F.lit(" is defined more than once")))]
    bases = own.where("base is not null").select(F.col("base").alias("name")).distinct()
    missing = bases.join(known, "name", "left_anti")
    found.append(problem(missing, "unresolved-reference", F.col("name"), F.concat(F.lit("no type is called "), F.col("name"))))

    # every (type, ancestor), built-in ancestors included
    edges = own.select(F.col("base").alias("a"), F.col("name").alias("b")).where("a is not null")
    pairs = cut(all_pairs(edges, "a", "b"))
    found.append(problem(pairs.where("a = b"), "circular-type", F.col("a"), F.concat(F.col("a"), F.lit(" is derived from itself"))))
    above = given_types.where("base is not null").select(F.col("name").alias("a"), F.col("base").alias("up"))
    given_pairs = all_pairs(above, "up", "a").select(F.col("a").alias("mid"), F.col("b").alias("low"))  # (ancestor, built-in type below it)
    through = pairs.where("a <> b").select("a", "b")
    lineage = cut(through.unionByName(through.join(F.broadcast(given_pairs), through["a"] == given_pairs["low"]).select(F.col("mid").alias("a"), "b")).distinct())
    primitive = (lineage.join(F.broadcast(given_types.where("primitive is not null").select(F.col("name").alias("a"), "primitive")), "a")
                 .groupBy(F.col("b").alias("name")).agg(F.min("primitive").alias("primitive")))

    # a facet fixed above may not be given again; such a row is not inherited either
    rows = facets.select("name", "facet", "value", F.coalesce("fixed", F.lit(False)).alias("fixed")).join(names, "name", "left_semi")
    every = rows.unionByName(given_facets)
    fixed_above = lineage.join(every.where("fixed").select(F.col("name").alias("a"), "facet"), "a").select(F.col("b").alias("name"), "facet").distinct()
    changed = rows.join(fixed_above, ["name", "facet"], "left_semi")
    found.append(problem(changed, "fixed-facet-overridden", F.col("name"), F.concat(F.col("facet"), F.lit(" is fixed by a type above"))))
    rows = rows.join(fixed_above, ["name", "facet"], "left_anti").join(primitive, "name", "left")

    @F.pandas_udf("boolean")
    def unreadable(primitive: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([not readable_bound(p, v) for p, v in zip(primitive, value)])

    @F.pandas_udf("boolean")
    def untranslated(value: pd.Series) -> pd.Series:
        return pd.Series([translate(v) is None for v in value])

    facet, value = F.col("facet"), F.col("value")
    bad = (F.when(facet.isin(*COUNTS), ~F.coalesce(value.rlike(r"\A[0-9]+\z"), F.lit(False))).when(facet == "white_space", ~F.coalesce(value.isin(*SPACES), F.lit(False)))
           .when(facet == "explicit_timezone", ~F.coalesce(value.isin("required", "optional", "prohibited"), F.lit(False)))
           .when(facet.isin(*BOUND_WORDS), F.col("_unreadable")).otherwise(~facet.isin(*FREE)))
    bounds = rows.where(facet.isin(*BOUND_WORDS)).select("primitive", "value").distinct().withColumn("_unreadable", unreadable("primitive", "value"))
    judged = (rows.alias("r").join(bounds.alias("u"), F.col("r.primitive").eqNullSafe(F.col("u.primitive")) & F.col("r.value").eqNullSafe(F.col("u.value")), "left")
              .select("r.*", "_unreadable").withColumn("_bad", bad))
    judged = cut(judged)
    found.append(problem(judged.where("_bad"), "bad-facet-value", F.col("name"), F.concat(facet, F.lit(" cannot be "), F.coalesce(value, F.lit("NULL")))))
    patterns = rows.where(facet == "pattern").select("value").distinct()
    lost = patterns.where(untranslated("value"))
    found.append(problem(rows.where(facet == "pattern").join(lost, "value", "left_semi"), "bad-pattern", F.col("name"), F.concat(F.lit("pattern cannot be read: "), value)))

    # the strictest inherited value against the own one; only decimal bounds are compared, as in `derive`
    rank = F.when(facet == "white_space", (F.array_position(F.array(*map(F.lit, SPACES)), value)).cast("decimal(38,18)")).otherwise(value.try_cast("decimal(38,18)"))
    compared = facet.isin(*COUNTS, "white_space") | (facet.isin(*BOUND_WORDS) & (F.col("primitive") == "decimal"))
    good = judged.where(~F.col("_bad") & compared).select("name", "facet", rank.alias("v"))
    given = given_facets.join(given_types.select("name", "primitive"), "name").where(compared).select("name", "facet", rank.alias("v"))
    inherited = skew_join(lineage, good.unionByName(given).select(F.col("name").alias("a"), "facet", "v"), ["a"])
    strictest = inherited.groupBy(F.col("b").alias("name"), "facet").agg(F.max("v").alias("_high"), F.min("v").alias("_low"))
    against = good.join(strictest, ["name", "facet"])
    looser = against.where(F.when(facet.isin(*RISING), F.col("v") < F.col("_high")).otherwise(F.col("v") > F.col("_low")))
    found.append(problem(looser, "facet-loosens-base", F.col("name"), F.concat(facet, F.lit(" is looser than in a type above"))))

    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    warning = F.col("code").isin("bad-pattern", "facet-loosens-base")
    return out.select(*finding(source="schema-health", severity=F.when(warning, "warning").otherwise("error"), code=F.col("code"), rule_id=F.col("name"), message=F.col("text")))
