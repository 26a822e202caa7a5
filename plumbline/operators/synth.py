"""Rows that satisfy a spec, and the ones among them nobody has changed yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.model import Model
from plumbline.functions.types import SimpleType

# What stands in for a value of each primitive.
SAMPLES = {"boolean": "false", "decimal": "0", "float": "0", "double": "0", "date": "2026-01-01", "dateTime": "2026-01-01T00:00:00",
           "time": "00:00:00", "gYear": "2026", "gYearMonth": "2026-01", "gMonth": "--01", "gMonthDay": "--01-01", "gDay": "---01",
           "duration": "P1D", "anyURI": "https://example.com", "hexBinary": "00", "base64Binary": "AA=="}


def placeholder(t: SimpleType, i: Column, spec: dict) -> Column:
    """A value that passes the type: fixed, default, an enumerated value (cycled by row), the
    pattern sample of the spec, a bound, or the primitive's own literal."""
    for name in ("fixed", "default"):
        if spec.get(name) is not None:
            return F.lit(spec[name])
    if t.enumeration:
        return F.get(F.array(*map(F.lit, t.enumeration)), F.pmod(i, F.lit(len(t.enumeration))).cast("int"))
    if t.patterns and spec.get("sample") is not None:
        return F.lit(spec["sample"])
    bounds = dict(t.bounds)
    for name in ("min_inclusive", "max_inclusive"):
        if name in bounds:
            return F.lit(bounds[name])
    if t.variety == "union" and t.members:
        return placeholder(t.members[0], i, {})
    if t.variety == "list":
        n = t.length or t.min_length or 0
        return F.array_join(F.array_repeat(placeholder(t.item, i, {}), n), " ")
    size = t.length if t.length is not None else (t.min_length or 0)
    if t.primitive in ("string", None):
        return F.lit("x" * size)
    return F.lit(SAMPLES.get(t.primitive, "x"))


def synthesise(ids: DataFrame, ident: str, spec: dict[str, dict], include: str = "required") -> DataFrame:
    """One valid row per id. Optional fields stay NULL unless include is "all"."""
    cols = []
    for c, s in spec.items():
        made = placeholder(s["type"], F.col(ident), s) if s.get("required") or include == "all" else F.lit(None)
        cols.append(made.cast("string").alias(c))
    return ids.select(ident, *cols)


def synthesise_groups(ids: DataFrame, ident: str, model: Model, include: str = "required", limit: int = 64) -> DataFrame:
    """Rows (id, ordinal, symbol) of one model-conforming group per id: the shortest word, or for
    "all" a walk that takes the first symbol the model offers, completed at the end."""
    word: list[str] = []
    state = 0
    if include == "all":
        visited: set[tuple[int, str]] = set()
        while len(word) < limit:
            options = [n for n in model.next_names(state) if (state, n) not in visited]
            if not options:
                break
            visited.add((state, options[0]))
            word.append(options[0])
            state = model.steps.one(state, model.names.index(options[0]))
    rest = model.shortest(state)
    if rest is None:
        raise ValueError("the model cannot be completed with named symbols")
    word += rest
    return ids.select(ident, F.posexplode(F.array(*map(F.lit, word)).cast("array<string>")).alias("ordinal", "symbol"))


def synthesise_nested(ids: DataFrame, ident: str, records: dict[str, dict], root: str, include: str = "required", depth: int = 6) -> DataFrame:
    """Nested records as one struct column `root`. records: {name: {"fields": spec, "children":
    {name: (min, max)}}}; a record inside itself is shown one level deep, and `depth` bounds the rest."""
    def build(name: str, left: int, stack: tuple[str, ...]) -> Column:
        spec = records[name]
        cols = [placeholder(s["type"], F.col(ident), s).cast("string").alias(c) for c, s in spec.get("fields", {}).items()
                if s.get("required") or include == "all"]
        if left > 0:
            for child, (lo, _) in spec.get("children", {}).items():
                if child in stack or (include == "required" and lo == 0):
                    continue
                cols.append(F.array_repeat(build(child, left - 1, (*stack, name)), max(lo, 1)).alias(child))
        return F.struct(*(cols or [F.lit(None).cast("string").alias("_VALUE")]))
    return ids.select(ident, build(root, depth, ()).alias(root))


def pending_review(df: DataFrame, generated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells still equal to what was generated: (keys, field, value). `generated` has (keys, field,
    value); a value changed and changed back counts as pending again."""
    fields = [c for c in df.columns if c not in keys]
    cells = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])))
    return cells.join(generated.select(*keys, "field", "value"), [*keys, "field", "value"], "left_semi")
