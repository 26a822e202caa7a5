"""Declared value types: a small driver-side spec that turns into Column predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import lexical as L
from plumbline.functions.patterns import translate
from plumbline.functions.text import let, normalize_space

PROBLEM = "struct<code:string,message:string>"
SPACE_RANK = {"preserve": 0, "replace": 1, "collapse": 2}
BOUND_WORDS = {"min_inclusive": "at least", "max_inclusive": "at most",
               "min_exclusive": "more than", "max_exclusive": "less than"}


@dataclass(frozen=True)
class SimpleType:
    name: str
    doc: str
    primitive: str | None = None
    white_space: str = "collapse"
    variety: str = "atomic"
    length: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    patterns: tuple[tuple[str, ...], ...] = ()
    enumeration: tuple[str, ...] | None = None
    by_value: bool = False
    bounds: tuple[tuple[str, str], ...] = ()
    total_digits: int | None = None
    fraction_digits: int | None = None
    explicit_timezone: str | None = None
    fixed: frozenset = frozenset()
    item: "SimpleType | None" = None
    members: tuple["SimpleType", ...] = ()
    ancestry: tuple[str, ...] = ()
    health: tuple[tuple[str, str, str], ...] = ()


# The named built-in types, their bases, whitespace and own facets.
_BUILTIN_ROWS = [
    ("anySimpleType", None, None, "preserve", {}),
    ("anyAtomicType", "anySimpleType", None, "preserve", {}),
    ("string", "anyAtomicType", "string", "preserve", {}),
    ("boolean", "anyAtomicType", "boolean", "collapse", {}),
    ("decimal", "anyAtomicType", "decimal", "collapse", {}),
    ("float", "anyAtomicType", "float", "collapse", {}),
    ("double", "anyAtomicType", "double", "collapse", {}),
    ("duration", "anyAtomicType", "duration", "collapse", {}),
    ("dateTime", "anyAtomicType", "dateTime", "collapse", {}),
    ("time", "anyAtomicType", "time", "collapse", {}),
    ("date", "anyAtomicType", "date", "collapse", {}),
    ("gYearMonth", "anyAtomicType", "gYearMonth", "collapse", {}),
    ("gYear", "anyAtomicType", "gYear", "collapse", {}),
    ("gMonthDay", "anyAtomicType", "gMonthDay", "collapse", {}),
    ("gDay", "anyAtomicType", "gDay", "collapse", {}),
    ("gMonth", "anyAtomicType", "gMonth", "collapse", {}),
    ("hexBinary", "anyAtomicType", "hexBinary", "collapse", {}),
    ("base64Binary", "anyAtomicType", "base64Binary", "collapse", {}),
    ("anyURI", "anyAtomicType", "anyURI", "collapse", {}),
    ("QName", "anyAtomicType", "QName", "collapse", {}),
    ("NOTATION", "anyAtomicType", "NOTATION", "collapse", {}),
    ("normalizedString", "string", "string", "replace", {}),
    ("token", "normalizedString", "string", "collapse", {}),
    ("language", "token", "string", "collapse", {"pattern": ["[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*"]}),
    ("Name", "token", "string", "collapse", {"pattern": [r"\i\c*"]}),
    ("NCName", "Name", "string", "collapse", {"pattern": [r"[\i-[:]][\c-[:]]*"]}),
    ("ID", "NCName", "string", "collapse", {}),
    ("IDREF", "NCName", "string", "collapse", {}),
    ("ENTITY", "NCName", "string", "collapse", {}),
    ("NMTOKEN", "token", "string", "collapse", {"pattern": [r"\c+"]}),
    ("integer", "decimal", "decimal", "collapse", {"fraction_digits": 0}),
    ("nonPositiveInteger", "integer", "decimal", "collapse", {"max_inclusive": "0"}),
    ("negativeInteger", "nonPositiveInteger", "decimal", "collapse", {"max_inclusive": "-1"}),
    ("long", "integer", "decimal", "collapse", {"min_inclusive": "-9223372036854775808", "max_inclusive": "9223372036854775807"}),
    ("int", "long", "decimal", "collapse", {"min_inclusive": "-2147483648", "max_inclusive": "2147483647"}),
    ("short", "int", "decimal", "collapse", {"min_inclusive": "-32768", "max_inclusive": "32767"}),
    ("byte", "short", "decimal", "collapse", {"min_inclusive": "-128", "max_inclusive": "127"}),
    ("nonNegativeInteger", "integer", "decimal", "collapse", {"min_inclusive": "0"}),
    ("unsignedLong", "nonNegativeInteger", "decimal", "collapse", {"max_inclusive": "18446744073709551615"}),
    ("unsignedInt", "unsignedLong", "decimal", "collapse", {"max_inclusive": "4294967295"}),
    ("unsignedShort", "unsignedInt", "decimal", "collapse", {"max_inclusive": "65535"}),
    ("unsignedByte", "unsignedShort", "decimal", "collapse", {"max_inclusive": "255"}),
    ("positiveInteger", "nonNegativeInteger", "decimal", "collapse", {"min_inclusive": "1"}),
    ("dateTimeStamp", "dateTime", "dateTime", "collapse", {"explicit_timezone": "required"}),
    ("yearMonthDuration", "duration", "duration", "collapse", {"pattern": ["[^DT]*"]}),
    ("dayTimeDuration", "duration", "duration", "collapse", {"pattern": ["[^YM]*(T.*)?"]}),
]
_BUILTIN_LISTS = [("IDREFS", "IDREF"), ("ENTITIES", "ENTITY"), ("NMTOKENS", "NMTOKEN")]


def readable_bound(primitive: str | None, value: str | None) -> bool:
    """Whether a bound is a value of its type; types without an order accept any, since they are not compared."""
    if value is None:
        return False
    if primitive == "decimal":
        return re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)", value) is not None
    if primitive in ("float", "double"):
        return re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN", value) is not None
    if primitive in L.TEMPORAL:
        return L.instant_of(value, primitive) is not None
    if primitive == "duration":
        return re.fullmatch(r"-?P(?=.)([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?", value) is not None
    return True


def derive(base: SimpleType, name: str | None = None, doc: str | None = None, fixed: Sequence[str] = (),
           **facets) -> SimpleType:
    """A restriction of `base`. A facet that cannot apply is left out and noted in `health`."""
    name = name or base.name
    health = list(base.health)
    note = lambda code, text: health.append((name, code, text))
    out: dict = {}
    for facet, value in facets.items():
        if facet in base.fixed:
            note("fixed-facet-overridden", f"{facet} is fixed by {base.name}")
            continue
        if facet in ("length", "min_length", "max_length", "total_digits", "fraction_digits"):
            if isinstance(value, bool) or not isinstance(value, int) or value < 0:
                note("bad-facet-value", f"{facet} needs a whole number from zero up, not {value!r}")
                continue
            old = getattr(base, facet)
            if old is not None:
                tight = max(old, value) if facet == "min_length" else min(old, value)
                if tight != value:
                    note("facet-loosens-base", f"{facet} {value} is looser than {old} in {base.name}")
                value = tight
            out[facet] = value
        elif facet == "white_space":
            if value not in SPACE_RANK:
                note("bad-facet-value", f"white_space cannot be {value!r}")
            elif SPACE_RANK[value] < SPACE_RANK[base.white_space]:
                note("facet-loosens-base", f"white_space {value} is weaker than {base.white_space} in {base.name}")
            else:
                out[facet] = value
        elif facet == "pattern":
            group = (value,) if isinstance(value, str) else tuple(value)
            for p in group:
                if translate(p) is None:
                    note("bad-pattern", f"pattern {p!r} cannot be read, so no value is checked against it")
            out["patterns"] = (*base.patterns, group)
        elif facet == "enumeration":
            out[facet] = tuple(value)
        elif facet in BOUND_WORDS:
            bounds, value = out.get("bounds", base.bounds), str(value)
            if not readable_bound(base.primitive, value):
                note("bad-facet-value", f"{facet} cannot be {value!r}")
                continue
            if base.primitive == "decimal":
                old = next((Decimal(b) for f, b in bounds if f == facet), None)
                if old is not None and (Decimal(value) > old if facet.startswith("max") else Decimal(value) < old):
                    note("facet-loosens-base", f"{facet} {value} is looser than {old} in {base.name}")
                    continue
                bounds = tuple(b for b in bounds if b[0] != facet)
            out["bounds"] = (*bounds, (facet, value))
        elif facet == "explicit_timezone":
            if value not in ("required", "optional", "prohibited"):
                note("bad-facet-value", f"explicit_timezone cannot be {value!r}")
            else:
                out[facet] = value
        elif facet == "by_value":
            out[facet] = bool(value)
        else:
            note("bad-facet-value", f"unknown facet {facet}")
    return replace(base, name=name, doc=doc or base.doc, fixed=base.fixed | frozenset(fixed),
                   ancestry=(base.name, *base.ancestry), health=tuple(health), **out)


def _builtins() -> dict[str, SimpleType]:
    table: dict[str, SimpleType] = {}
    for name, base, primitive, space, facets in _BUILTIN_ROWS:
        doc = f"of type {name}"
        if base is None or table[base].primitive is None:
            table[name] = SimpleType(name, doc, primitive, space, ancestry=((base, *table[base].ancestry) if base else ()))
            if facets:
                table[name] = derive(table[name], name, doc, **facets)
        else:
            table[name] = derive(replace(table[base], white_space=space), name, doc, **facets)
    for name, item in _BUILTIN_LISTS:
        table[name] = list_of(table[item], name)
    return table


def list_of(item: SimpleType, name: str, **facets) -> SimpleType:
    made = SimpleType(name, f"a list of {item.name} values", None, "collapse", "list", item=item,
                      ancestry=("anySimpleType",), health=item.health)
    return derive(made, name, **facets) if facets else made


def union_of(members: Sequence[SimpleType], name: str, **facets) -> SimpleType:
    made = SimpleType(name, "any of " + ", ".join(m.name for m in members), None, "preserve", "union",
                      members=tuple(members), ancestry=("anySimpleType",))
    return derive(made, name, **facets) if facets else made


BUILTINS = _builtins()


def builtin(type_name: str, **facets) -> SimpleType:
    base = BUILTINS[type_name]
    return derive(base, facets.pop("name", type_name), **facets) if facets else base


def compile_types(specs: dict[str, dict]) -> tuple[dict[str, SimpleType], list[tuple[str, str, str]]]:
    """Named specs {name: {base: ..., facets...}} to types. A bad spec degrades to "any value" and
    is reported; it never stops the others."""
    done: dict[str, SimpleType] = {}
    health: list[tuple[str, str, str]] = []

    def build(name: str, trail: tuple[str, ...]) -> SimpleType:
        if name in done:
            return done[name]
        if name in trail:
            health.append((name, "circular-type", f"{name} is derived from itself"))
            return BUILTINS["anySimpleType"]
        if name not in specs:
            if name in BUILTINS:
                return BUILTINS[name]
            health.append((name, "unresolved-reference", f"no type is called {name}"))
            return BUILTINS["anySimpleType"]
        spec = dict(specs[name])
        base = spec.pop("base", "anySimpleType")
        try:
            if "item" in spec:
                made = list_of(build(spec.pop("item"), (*trail, name)), name, **spec)
            elif "members" in spec:
                made = union_of([build(m, (*trail, name)) for m in spec.pop("members")], name, **spec)
            else:
                made = derive(build(base, (*trail, name)), name, **spec)
        except (TypeError, ValueError) as bad:
            health.append((name, "bad-facet-value", str(bad)))
            made = BUILTINS["anySimpleType"]
        done[name] = made
        return made

    for name in specs:
        build(name, ())
    for made in done.values():
        health.extend(h for h in made.health if h not in health)
    return done, health


# --- predicates ----------------------------------------------------------------------------------

def _problem(broken: Column, code: str, message: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(code).alias("code"), message.alias("message")))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def length_broken(v: Column, t: SimpleType, size: Column | None = None) -> list[tuple[str, Column, str]]:
    size = L.value_length(v, t.primitive) if size is None else size
    unit = "items" if t.variety == "list" else "characters"
    rows = [("length", "cvc-length-valid", lambda n: size != n, "exactly"),
            ("min_length", "cvc-minLength-valid", lambda n: size < n, "at least"),
            ("max_length", "cvc-maxLength-valid", lambda n: size > n, "at most")]
    return [(code, test(getattr(t, facet)), f"needs {word} {getattr(t, facet)} {unit}")
            for facet, code, test, word in rows if getattr(t, facet) is not None]


def pattern_ok(v: Column, groups: Sequence[Sequence[str]]) -> Column:
    """AND over derivation steps, OR inside one; a step nothing in which can be read passes."""
    ok = F.lit(True)
    for group in groups:
        usable = [p for p in map(translate, group) if p is not None]
        if usable:
            ok = ok & reduce(lambda a, b: a | b, [v.rlike(p) for p in usable])
    return ok


def enumeration_ok(v: Column, t: SimpleType) -> Column:
    if t.by_value and t.primitive:
        return reduce(lambda a, b: a | b,
                      [F.coalesce(L.compare(v, F.lit(e), t.primitive) == 0, F.lit(False)) for e in t.enumeration], F.lit(False))
    return v.isin(*t.enumeration) if t.enumeration else F.lit(False)


def bound_broken(v: Column, primitive: str, facet: str, bound: str) -> Column:
    """True where the value is on the wrong side; unordered or incomparable values pass."""
    if primitive not in L.ORDERED:
        return F.lit(False)
    wrong = {"min_inclusive": lambda o: o < 0, "max_inclusive": lambda o: o > 0,
             "min_exclusive": lambda o: o <= 0, "max_exclusive": lambda o: o >= 0}[facet]
    side = lambda a, b: {"min_inclusive": a < b, "max_inclusive": a > b, "min_exclusive": a <= b, "max_exclusive": a >= b}[facet]
    if primitive == "decimal":
        exact = wrong(L.decimal_order(v, F.lit(bound)))
        if len(bound) > 20:
            return exact
        # short texts stay in plain decimal arithmetic (and in generated code)
        n, b = v.try_cast("decimal(38,18)"), F.lit(Decimal(bound)).cast("decimal(38,18)")
        return F.when(F.length(v) <= 19, side(n, b)).otherwise(exact)
    if primitive in L.TEMPORAL:
        at = L.instant_of(bound, primitive)
        if at is None:
            return F.lit(False)
        exact = side(L.instant(v, primitive), F.lit(at).cast("decimal(38,9)"))
        # zone-less four-digit-year texts order like their characters
        plain = {"date": 10, "dateTime": 19}.get(primitive)
        if plain == len(bound) and not bound.endswith("Z") and "T24" not in bound:
            return F.when((F.length(v) == plain) & ~F.contains(v, F.lit("T24")), side(v, F.lit(bound))).otherwise(exact)
        return exact
    if primitive in ("float", "double"):
        b = float(bound.replace("INF", "inf"))
        n = L.float_value(v, primitive)
        return ~F.isnan(n) & side(n, F.lit(b)) if b == b else F.lit(False)
    return wrong(L.compare(v, F.lit(bound), primitive))


def digits(v: Column) -> tuple[Column, Column]:
    """(total, fraction) digit counts without leading and trailing zeros."""
    whole = F.length(F.regexp_replace(F.regexp_extract(v, r"\A[+-]?(\d*)", 1), r"\A0+", ""))
    fraction = F.length(F.regexp_replace(F.regexp_extract(v, r"\.(\d*)\z", 1), r"0+\z", ""))
    return whole + fraction, fraction


def has_timezone(v: Column) -> Column:
    return v.rlike(L.OFFSET)


def _facets(v: Column, t: SimpleType, size: Column | None = None) -> list[tuple[str, Column, Column]]:
    """(code, broken, message) for every facet of the type, on the normalised value."""
    rows = [(code, broken, F.concat(_quoted(v), F.lit(f" {text}"))) for code, broken, text in length_broken(v, t, size)]
    if t.patterns:
        shown = " or ".join(t.patterns[-1])
        rows.append(("cvc-pattern-valid", ~pattern_ok(v, t.patterns), F.concat(_quoted(v), F.lit(f" does not match {shown}"))))
    if t.enumeration is not None:
        more = f" and {len(t.enumeration) - 8} more" if len(t.enumeration) > 8 else ""
        allowed = ", ".join(t.enumeration[:8]) + more
        text = F.concat(_quoted(v), F.lit(f" is not one of {allowed}")) if t.enumeration else F.lit("no value is allowed")
        rows.append(("cvc-enumeration-valid", ~enumeration_ok(v, t), text))
    if t.primitive:
        for facet, bound in t.bounds:
            rows.append(("cvc-range-valid", bound_broken(v, t.primitive, facet, bound),
                         F.concat(_quoted(v), F.lit(f" must be {BOUND_WORDS[facet]} {bound}"))))
        if t.primitive == "decimal":
            total, fraction = digits(v)
            if t.fraction_digits is not None:
                text = "is not a whole number" if t.fraction_digits == 0 else f"has more than {t.fraction_digits} decimal places"
                rows.append(("cvc-fractionDigits-valid", fraction > t.fraction_digits, F.concat(_quoted(v), F.lit(f" {text}"))))
            if t.total_digits is not None:
                rows.append(("cvc-totalDigits-valid", total > t.total_digits,
                             F.concat(_quoted(v), F.lit(f" has more than {t.total_digits} digits"))))
        if t.explicit_timezone in ("required", "prohibited"):
            broken = ~has_timezone(v) if t.explicit_timezone == "required" else has_timezone(v)
            rows.append(("cvc-explicitTimezone-valid", broken, F.concat(_quoted(v), F.lit(f": a time zone is {t.explicit_timezone}"))))
    return rows


def _untidy(col: Column, mode: str) -> Column:
    """Whether whitespace handling would change the text at all."""
    return col.rlike("[\t\n\r]" if mode == "replace" else r"[\t\n\r]|\A | \z|  ")


def _verdict(v: Column, t: SimpleType) -> Column:
    """Verdict on a normalised value."""
    if t.variety == "list":
        items = F.filter(F.split(v, " "), lambda x: x != "")
        ok = F.forall(items, lambda x: _verdict(x, t.item))
        facets = _facets(v, t, F.size(items))
    elif t.variety == "union":
        ok = _any_member(v, t)
        facets = _facets(v, t)
    else:
        ok = L.is_lexical(v, t.primitive) if t.primitive else F.lit(True)
        facets = _facets(v, t)
    for _, broken, _ in facets:
        ok = ok & ~F.coalesce(broken, F.lit(False))
    return ok


def _any_member(v: Column, t: SimpleType) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(is_valid(v, m), F.lit(False)) for m in t.members], F.lit(not t.members))


def is_valid(col: Column, t: SimpleType) -> Column:
    """Boolean verdict for a non-NULL value; NULL stays NULL (absence is the record's business).

    Tidy text is judged as it stands; only text that whitespace handling changes is normalised.
    """
    if t.white_space == "preserve":
        return F.when(col.isNotNull(), _verdict(col, t))
    if t.white_space == "collapse" and t.primitive not in (None, "string", "anyURI", "base64Binary"):
        tidy = _verdict(col, t)  # no lexical form of these types has a space in it
    else:
        tidy = ~_untidy(col, t.white_space) & _verdict(col, t)
    return F.when(col.isNotNull(), tidy | (_untidy(col, t.white_space) & let(normalize_space(col, t.white_space), lambda v: _verdict(v, t))))


def surely_valid(col: Column, t: SimpleType) -> Column:
    """True only for absent values and for valid ones that need no whitespace handling: a cheap
    first filter, generated as plain code; what it refuses goes through `problems`."""
    tidy = F.lit(True)
    if t.white_space != "preserve" and t.primitive in (None, "string", "anyURI", "base64Binary"):
        tidy = ~_untidy(col, t.white_space)
    return col.isNull() | (tidy & F.coalesce(_verdict(col, t), F.lit(False)))


def problems(col: Column, t: SimpleType) -> Column:
    """All problems of a value, as an array; a value outside the lexical space reports only that."""
    if t.white_space == "preserve":
        return problems_of_normal(col, t)
    return let(normalize_space(col, t.white_space), lambda v: problems_of_normal(v, t))


def problem_rows(v: Column, t: SimpleType) -> list[tuple[str, Column, Column]]:
    """(code, broken, message) for each way a normalised value can fail; not for list types."""
    if t.variety == "union":
        return [("cvc-datatype-valid.1.2.3", ~_any_member(v, t), F.concat(_quoted(v), F.lit(f" is not {t.doc}"))), *_facets(v, t)]
    if not t.primitive:
        return _facets(v, t)
    lexical = L.is_lexical(v, t.primitive)
    outside = ("cvc-datatype-valid.1.2.1", ~lexical, F.concat(_quoted(v), F.lit(f" is not {t.doc}")))
    return [outside, *[(code, lexical & broken, message) for code, broken, message in _facets(v, t)]]


def problems_of_normal(v: Column, t: SimpleType) -> Column:
    """The same for a value whose whitespace is already handled."""
    empty = F.array().cast(f"array<{PROBLEM}>")
    def listed(rows) -> Column:
        if not rows:
            return empty
        return F.array_compact(F.array(*[_problem(b, c, m) for c, b, m in rows])).cast(f"array<{PROBLEM}>")
    if t.variety == "list":
        items = F.filter(F.split(v, " "), lambda x: x != "")
        inner = F.flatten(F.transform(items, lambda x: F.transform(problems_of_normal(x, t.item), lambda p: F.struct(
            p["code"].alias("code"), F.concat(F.lit("item "), x, F.lit(": "), p["message"]).alias("message")))))
        out = F.concat(listed(_facets(v, t, F.size(items))), inner.cast(f"array<{PROBLEM}>"))
    else:
        out = listed(problem_rows(v, t))
    return F.when(v.isNotNull(), out).otherwise(empty)


def matched_member(col: Column, t: SimpleType) -> Column:
    """Name of the first union member that accepts the value."""
    v = normalize_space(col, t.white_space)
    return F.coalesce(*[F.when(is_valid(v, m), F.lit(m.name)) for m in t.members])


def fixed_value_broken(col: Column, value: str, t: SimpleType | None = None) -> Column:
    """A fixed value: text is compared after whitespace handling, a field (no type given) as it is."""
    seen = normalize_space(col, t.white_space) if t else col
    return F.when(col.isNotNull(), seen != F.lit(value))


def starting_value(spec: dict) -> str | None:
    """Fixed, else default, else the only enumerated value."""
    for name in ("fixed", "default"):
        if spec.get(name) is not None:
            return spec[name]
    t = spec.get("type")
    return t.enumeration[0] if t is not None and t.enumeration and len(t.enumeration) == 1 else None
