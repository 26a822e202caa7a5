"""Typed column checks, fix candidates and their application."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import let, normalize_space, strip
from plumbline.functions.types import (SimpleType, fixed_value_broken, is_valid, problem_rows, problems_of_normal, starting_value,
                                      surely_valid)
from plumbline.operators.findings import FIX, SCHEMA, finding, key_text


def check_column(df: DataFrame, col: str, t: SimpleType, key: Sequence[str], doc: str | None = None,
                 fixes: bool = False) -> DataFrame:
    return check_table(df, {col: t}, key, doc, fixes)


def check_table(df: DataFrame, spec: dict[str, SimpleType], key: Sequence[str], doc: str | None = None,
                fixes: bool = False) -> DataFrame:
    """One pass over the table for all typed columns: a cheap verdict filter first, then problem
    details for the rows it refuses. Columns are read as text."""
    text = {c: F.col(c).cast("string") for c in spec}
    failing = reduce(lambda a, b: a | b, [~surely_valid(text[c], t) for c, t in spec.items()])
    tidy = {c: f"_v{i}" for i, c in enumerate(spec)}
    kept = df.where(failing).withColumns({tidy[c]: normalize_space(text[c], t.white_space) for c, t in spec.items()})
    # one slot per possible problem; empty slots go before the explode, so only real problems make rows
    slot = lambda c, code, message: F.struct(F.lit(c).alias("column"), F.struct(code.alias("code"), message.alias("message")).alias("p"))
    slots = [F.when(F.coalesce(broken, F.lit(False)), slot(c, F.lit(code), message))
             for c, t in spec.items() if t.variety != "list" for code, broken, message in problem_rows(F.col(tidy[c]), t)]
    arrays = [F.array_compact(F.array(*slots))] if slots else []
    def of_list(c: str, t: SimpleType) -> Column:
        return F.transform(problems_of_normal(F.col(tidy[c]), t), lambda p: slot(c, p["code"], p["message"]))
    arrays += [of_list(c, t) for c, t in spec.items() if t.variety == "list"]
    every = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    rows = kept.select("*", F.explode(every).alias("_x"))
    fix = F.lit(None)
    if fixes:
        for c, t in spec.items():
            fix = F.when(F.col("_x.column") == c, fix_candidates(text[c], t)).otherwise(fix)
    return rows.select(*finding(
        source="schema", severity="error", code=F.col("_x.p.code"), row_key=key_text(*key),
        doc_key=key_text(doc) if doc else None, anchor="text", column=F.col("_x.column"),
        message=F.concat_ws(": ", "_x.column", "_x.p.message"),
        technical=F.concat_ws(" ", "_x.p.code", F.lit("on"), "_x.column"), fixes=fix))


def check_fixed(df: DataFrame, col: str, value: str, key: Sequence[str], t: SimpleType | None = None) -> DataFrame:
    code, anchor = ("cvc-elt.5.2.2.2.1", "text") if t else ("cvc-attribute.4", "attribute")
    fix = F.array(F.struct(F.lit(f'Set to "{value}"').alias("title"), F.lit(value).alias("value"), F.lit(False).alias("speculative")))
    return df.where(fixed_value_broken(F.col(col), value, t)).select(*finding(
        source="schema", severity="error", code=code, row_key=key_text(*key), anchor=anchor, column=col,
        message=f'{col}: the only value allowed is "{value}"', fixes=fix))


def fill_defaults(df: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """NULL fields take their starting value (fixed, default, or the only enumerated one)."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, s in spec.items() if (v := starting_value(s)) is not None}
    return df.withColumns(filled)


def spec_health(spark: SparkSession, health: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Problems of the spec itself as findings, so that they are not mistaken for data problems."""
    warn = {"bad-pattern", "facet-loosens-base"}
    rows = [("schema-health", "warning" if code in warn else "error", code, name, text) for name, code, text in health]
    df = spark.createDataFrame(rows, "source string, severity string, code string, name string, message string")
    return df.select(*finding(source=F.col("source"), severity=F.col("severity"), code=F.col("code"),
                              rule_id=F.col("name"), message=F.col("message")))


# --- fixes ---------------------------------------------------------------------------------------

def _same_letters(v: Column, t: SimpleType) -> list[Column]:
    return [F.get(F.filter(F.array(*map(F.lit, t.enumeration)), lambda o: F.lower(o) == F.lower(v)), F.lit(0))] if t.enumeration else []


def _nearest(v: Column, t: SimpleType) -> list[Column]:
    """The enumerated value with the fewest edits, the first of equals; none beyond three edits."""
    if not t.enumeration:
        return []
    ranked = F.transform(F.array(*map(F.lit, t.enumeration)), lambda o, i: F.struct(F.levenshtein(F.lower(o), F.lower(v)).alias("edits"), i.alias("at"), o.alias("value")))
    best = F.array_min(ranked)
    return [F.when(best["edits"] <= 3, best["value"])]


def _limits(v: Column, t: SimpleType) -> list[Column]:
    return [F.lit(bound) for facet, bound in t.bounds if facet.endswith("_inclusive")]


def _cut(v: Column, t: SimpleType) -> list[Column]:
    most = t.length if t.max_length is None else t.max_length
    return [F.left(v, F.lit(most))] if most is not None and t.variety == "atomic" else []


def _whole(v: Column, t: SimpleType) -> list[Column]:
    return [F.when(v.rlike(r"\A[+-]?\d+\.0*\z"), F.substring_index(v, ".", 1))] if t.primitive == "decimal" else []


#: Kinds of fix in the order of their rank: (title, whether it guesses, values that it proposes for a trimmed text and a type).
#: Fixes that keep the meaning come first.
FIX_KINDS = (
    ("without outer blanks", False, lambda v, t: [v]),
    ("spelling of the list", False, _same_letters),
    ("as a whole number", False, _whole),
    ("nearest listed value", True, _nearest),
    ("in capitals", True, lambda v, t: [F.upper(v)] if t.patterns else []),
    ("without blanks and hyphens", True, lambda v, t: [F.regexp_replace(v, r"[\s-]", "")] if t.patterns else []),
    ("cut to length", True, _cut),
    ("moved to the limit", True, _limits),
)


def fix_candidates(col: Column, t: SimpleType, sample: str | None = None) -> Column:
    """Every fix that changes the value and makes it valid, by rank of its kind, each value once. A sample comes last."""
    kinds = (*FIX_KINDS, ("example", True, lambda v, t: [F.lit(sample)] if sample else []))
    text = strip(col)
    out = [F.struct(F.concat(F.lit(f"{title}: "), value).alias("title"), value.alias("value"), F.lit(guess).alias("speculative"))
           for title, guess, propose in kinds for value in propose(text, t)]
    valid = F.filter(F.array(*out), lambda f: F.coalesce((f["value"] != col) & is_valid(f["value"], t), F.lit(False)))
    once = lambda u: F.filter(u, lambda f, i: F.array_position(F.transform(u, lambda g: g["value"]), f["value"]) == i + 1)
    return let(valid, once).cast(f"array<{FIX}>")


def best_fix(col: Column, t: SimpleType, speculative: bool = False, sample: str | None = None) -> Column:
    """The first applicable fix of a failing value; speculative ones only on request."""
    found = fix_candidates(col, t, sample)
    if not speculative:
        found = F.filter(found, lambda f: ~f["speculative"])
    return F.when(~is_valid(col, t), F.get(found, F.lit(0)))


def apply_fixes(df: DataFrame, spec: dict[str, SimpleType], key: Sequence[str],
                speculative: bool = False) -> tuple[DataFrame, DataFrame]:
    """(repaired table, audit of changes). Values no fix makes valid are left as they are."""
    place = {c: f"_fix{i}" for i, c in enumerate(spec)}
    fixed = df.withColumns({place[c]: best_fix(F.col(c), t, speculative) for c, t in spec.items()})
    fixes = {c: F.col(p) for c, p in place.items()}
    repaired = fixed.withColumns({c: F.coalesce(f["value"], F.col(c)) for c, f in fixes.items()}).drop(*place.values())
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("old"), f["value"].alias("new"),
                              f["title"].alias("title"), f["speculative"].alias("speculative")) for c, f in fixes.items()])
    audit = fixed.select(*key, F.explode(F.filter(rows, lambda r: r["new"].isNotNull())).alias("_r"))
    return repaired, audit.select(*key, "_r.*")


def plausible_name(name: Column, names: Sequence[str]) -> Column:
    """Nearest declared name, without regard to case, if near enough to be meant; else NULL.

    Near enough: at most a third of the longer name, at least one edit, never more than three.
    """
    options = F.array(*map(F.lit, names))
    scored = F.transform(options, lambda o, i: F.struct(
        F.levenshtein(F.lower(name), F.lower(o)).alias("d"), i.alias("i"), o.alias("o")))
    allowed = lambda s: F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.greatest(F.length(name), F.length(s["o"])) / 3).cast("int")))
    return F.array_min(F.filter(scored, lambda s: s["d"] <= allowed(s)))["o"]


def did_you_mean(df: DataFrame, name: str, dictionary: Sequence[str], out: str = "suggestion") -> DataFrame:
    """Suggest a declared name for each row; distinct names are scored once."""
    from plumbline.plans.skew import skew_join
    scored = df.select(name).distinct().withColumn(out, plausible_name(F.col(name), dictionary))
    return skew_join(df, scored, [name], "left")


def rename_fields(df: DataFrame, declared: Sequence[str], keep_unknown: bool = False) -> DataFrame:
    """Misnamed columns take the declared name they were probably meant to be; others are dropped."""
    from plumbline.functions.names import nearest
    taken = set(df.columns) & set(declared)
    out = []
    for c in df.columns:
        target = c if c in declared else nearest(c, [d for d in declared if d not in taken])
        if target is not None:
            taken.add(target)
            out.append(F.col(c).alias(target))
        elif keep_unknown:
            out.append(F.col(c))
    return df.select(*out)


def rename_keys(map_col: Column, declared: Sequence[str]) -> Column:
    """The same for the keys of a map column: rename to the probable name, else remove."""
    target = lambda k: F.coalesce(F.when(k.isin(*declared), k), plausible_name(k, declared))
    entries = F.filter(F.map_entries(map_col), lambda e: target(e["key"]).isNotNull())
    named = F.transform(entries, lambda e: F.struct(target(e["key"]).alias("key"), e["value"].alias("value"), (~e["key"].isin(*declared)).alias("moved")))
    # a declared spelling wins over a corrected one, and the first of two corrections is kept
    first = F.filter(named, lambda e, i: ~F.exists(named, lambda o: (o["key"] == e["key"]) & ~o["moved"] & e["moved"])
                     & (F.array_position(F.transform(named, lambda o: F.struct(o["key"], o["moved"])), F.struct(e["key"], e["moved"])) == i + 1))
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], e["value"])))
