"""SQL expressions of which one bad row does not end the job.

Arithmetic, casts and a few functions that raise under ANSI rules become Spark's own try_ functions; everything else of the text
stays as it is. Beside the value a flag says that one of them had operands but no result. A row whose value is NULL and
whose flag is set could not be evaluated; where the value does not depend on the failed part (`b <> 0 and a / b > 1`), it stands.

Overflow of whole numbers is common where it happens at all, and a try_ function raises and catches an error for each such row. So
sums, products and casts of whole numbers are computed in a wider type, and text is looked at before it is cast to a whole number;
what does not fit is taken out of an array of one, which yields NULL without an error. Other casts of text still raise inside.

Quoted text is never touched. The result is used only where Spark gives it the type of the original; texts with a subquery
are left alone, and a part inside a lambda yields NULL without a flag. Implicit casts of text and array subscripts keep Spark's behaviour.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/
  |(?P<text>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
  |(?P<name>`(?:[^`]|``)*`|[A-Za-z_$][\w$]*)
  |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:BD|[LSYDFlsydf])?\b)
  |(?P<sign><=>|<=|>=|<>|!=|==|->|=>|::|\|\||.)""", re.X | re.S)

#: Operators that raise and what takes their place, by how tightly they bind.
_PRODUCT = {"*": "try_multiply", "/": "try_divide", "%": "try_mod", "div": "div"}
#: Whole numbers by their width, and their bits.
_WHOLE = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
_SUM = {"+": "try_add", "-": "try_subtract", "||": "||"}
#: Functions that raise on some values, with a variant that does not.
_CALLS = {"cast": "try_cast", "element_at": "try_element_at", "to_timestamp": "try_to_timestamp", "to_number": "try_to_number", "to_binary": "try_to_binary",
          "url_decode": "try_url_decode", "parse_url": "try_parse_url", "parse_json": "try_parse_json", "to_date": "try_to_date", "make_timestamp": "try_make_timestamp"}
#: Words between operands that bind less tightly than arithmetic.
_WORDS = frozenset("and or not between in like ilike rlike regexp is when then else as escape from for distinct both leading trailing at over partition by order asc desc".split())


@dataclass
class Guarded:
    """The rewritten text, and the conditions under which a part of it failed."""

    sql: str
    flags: list[str] = field(default_factory=list)

    @property
    def failed(self) -> str:
        return "coalesce(" + " or ".join(dict.fromkeys(self.flags)) + ", false)" if self.flags else "false"


class _Reader:
    def __init__(self, tokens: list[tuple[str, str]], kind: Callable[[str], str | None]):
        self.tokens, self.at, self.flags, self.kind = tokens, 0, [], kind

    def peek(self) -> str:
        return self.tokens[self.at][1].lower() if self.at < len(self.tokens) else ""

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def level(self, closing: str) -> str:
        """Text up to a closing sign, which is consumed."""
        out: list[str] = []
        run: list[tuple[bool, str]] = []  # (operator, text) since the last word or sign that binds less tightly
        kept = len(self.flags)
        bound = False
        while self.at < len(self.tokens) and self.peek() != closing:
            kind, text = self.take()
            low = text.lower()
            operand = bool(run) and not run[-1][0]
            if kind == "sign" and text in "([":
                inner = self.level(")" if text == "(" else "]")
                if text == "[" and operand:
                    run[-1] = (False, f"{run[-1][1]}[{inner}]")
                else:
                    self.put(run, f"({inner})")
            elif kind == "name" and low == "case":
                self.put(run, f"case {self.level('end')} end")
            elif kind == "name" and self.peek() == "(" and low not in _WORDS and not (operand and low in _PRODUCT):
                self.take()
                self.put(run, self.call(text))
            elif kind == "sign" and text == "." and operand:
                run[-1] = (False, run[-1][1] + "." + self.take()[1])
            elif kind == "sign" and text == "::" and operand:
                wanted = self.take()[1]
                if self.peek() == "(":
                    self.take()
                    wanted += f"({self.level(')')})"
                run[-1] = (False, self.cast(run[-1][1], wanted))
            elif (low in _PRODUCT or low in _SUM) and (operand or text in "+-"):
                run.append((True, low))
            elif kind == "sign" and text not in "*{}" or low in _WORDS:
                bound = bound or text == "->"
                out += [self.arithmetic(run), text]
                run = []
            else:
                self.put(run, text)
        self.at += 1
        if bound:
            del self.flags[kept:]  # they would name variables of the lambda
        return " ".join(x for x in [*out, self.arithmetic(run)] if x)

    @staticmethod
    def put(run: list[tuple[bool, str]], text: str) -> None:
        """An operand; two in a row are one (date '2020-01-01', interval 1 day)."""
        if run and not run[-1][0]:
            run[-1] = (False, f"{run[-1][1]} {text}")
        else:
            run.append((False, text))

    def call(self, name: str) -> str:
        start = self.at
        inner = self.level(")")
        tried = _CALLS.get(name.lower())
        if not tried:
            return f"{name}({inner})"
        if name.lower() != "cast":
            text = f"{tried}({inner})"
            if any(t[1] == "," for t in self.tokens[start:self.at]):  # which operands were there is not told apart
                return text
            return self.flagged(text, [inner])
        parts = re.split(r"(?i)\s+as\s+", inner)
        return self.cast(inner[:inner.rindex(parts[-1])].rstrip()[:-2].rstrip(), parts[-1]) if len(parts) > 1 else f"{name}({inner})"

    def cast(self, value: str, wanted: str) -> str:
        named = wanted.strip().lower()
        to, given = {"integer": "int", "long": "bigint", "short": "smallint", "byte": "tinyint"}.get(named, named), self.kind(value)
        if to in _WHOLE and given in _WHOLE:
            return self.flagged(self.narrow(value, "bigint", to), [value])
        if to in _WHOLE and given == "string":
            digits, wide = (38, "decimal(38,0)") if to == "bigint" else (18, "bigint")
            numeral = rf"get(filter(array({value}), _v -> _v rlike r'^[\x00-\x20\x7F]*[+-]?0*[0-9]{{1,{digits}}}[\x00-\x20\x7F]*$'), 0)"
            return self.flagged(self.narrow(f"try_cast({numeral} as {wide})", wide, to), [value])
        return self.flagged(f"try_cast({value} as {wanted})", [value])

    @staticmethod
    def narrow(value: str, given: str, to: str) -> str:
        """A whole number of a wider type, NULL where it does not fit."""
        if given == to:
            return f"({value})"
        suffix, half = ("" if given == "bigint" else "BD"), 1 << _WHOLE[to] - 1
        low = f"(-{half - 1}{suffix or 'L'} - 1{suffix or 'L'})"
        return f"cast(get(filter(array({value}), _v -> _v between {low} and {half - 1}{suffix or 'L'}), 0) as {to})"

    def whole(self, left: str, operator: str, right: str) -> str | None:
        """A sum or product of two whole numbers, NULL where it does not fit their type; None for operands of other types."""
        kinds = self.kind(left), self.kind(right)
        if operator not in "+-*" or not all(k in _WHOLE for k in kinds):
            return None
        result = max(kinds, key=_WHOLE.get)
        wide = "decimal(20,0)" if result == "bigint" else "bigint"
        return self.narrow(f"cast({left} as {wide}) {operator} cast({right} as {wide})", wide, result)

    def flagged(self, text: str, operands: list[str]) -> str:
        present = " and ".join(f"({o}) is not null" for o in operands)
        self.flags.append(f"({text} is null and {present})")
        return text

    def arithmetic(self, run: list[tuple[bool, str]]) -> str:
        """Operands and operators in their order, products before sums, each from the left."""
        items: list[tuple[bool, str]] = []
        for operator, text in run:  # a sign without a left operand belongs to what follows
            if not operator and items and items[-1][0] and (len(items) == 1 or items[-2][0]) and items[-1][1] in "+-":
                items[-1] = (False, items[-1][1] + " " + text)
                while len(items) > 1 and items[-2][0] and items[-2][1] in "+-" and (len(items) == 2 or items[-3][0]):
                    items[-2:] = [(False, items[-2][1] + " " + items[-1][1])]
            else:
                items.append((operator, text))
        for table in (_PRODUCT, _SUM):
            i = 1
            while i + 1 < len(items):
                if items[i][0] and items[i][1] in table and not items[i - 1][0] and not items[i + 1][0]:
                    left, right, tried = items[i - 1][1], items[i + 1][1], table[items[i][1]]
                    if tried == "||":
                        text = f"({left} || {right})"
                    elif tried == "div":
                        text = self.flagged(f"({left} div nullif({right}, 0))", [left, right])
                    else:
                        text = self.flagged(self.whole(left, items[i][1], right) or f"{tried}({left}, {right})", [left, right])
                    items[i - 1:i + 2] = [(False, text)]
                else:
                    i += 1
        return " ".join(text for _, text in items)


def guarded(sql: str, kind: Callable[[str], str | None] = lambda text: None) -> Guarded:
    """The expression with its raising operators replaced; unchanged where brackets or quotes do not match. `kind` names the type of a
    part of it, or None where that is not known."""
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql) if m.lastgroup]
    if any(t[1].lower() == "select" for t in tokens):
        return Guarded(sql)
    reader = _Reader(tokens, kind)
    text = reader.level("")
    if reader.at != len(tokens) + 1 or any(t in ("'", '"', "`") for _, t in tokens):
        return Guarded(sql)
    return Guarded(text, reader.flags)


class Scope:
    """Expressions over one table, analysed before any job runs."""

    def __init__(self, df: DataFrame):
        self.empty = df.limit(0)
        self.errors: dict[tuple[str, str], str | None] = {}
        self.made: dict[str, Guarded] = {}

    def broken(self, sql: str, kind: str = "boolean") -> str | None:
        """Why the expression cannot be evaluated on any row, or None."""
        if (sql, kind) not in self.errors:
            try:
                if "$" in re.sub(r"'[^']*'", "", sql):
                    raise ValueError("a name in it is not bound")
                self.empty.select(F.expr(sql).cast(kind)).schema
                self.errors[sql, kind] = None
            except (AnalysisException, ValueError) as error:
                self.errors[sql, kind] = str(error).split("\n")[0][:300]
        return self.errors[sql, kind]

    def kind(self, sql: str) -> str | None:
        """The type of a part of an expression; None for one that stands in a lambda, whose names are its own."""
        try:
            return self.empty.select(F.expr(sql)).schema[0].dataType.simpleString()
        except AnalysisException:
            return None

    def guard(self, sql: str) -> Guarded:
        if sql not in self.made:
            made = guarded(sql, self.kind)
            try:
                own = self.empty.select(F.expr(sql)).schema[0].dataType
                fits = self.empty.select(F.expr(made.sql), F.expr(made.failed)).schema[0].dataType == own
            except AnalysisException:
                fits = False
            self.made[sql] = made if fits else Guarded(sql)
        return self.made[sql]

    def value(self, sql: str) -> Column:
        """The value, NULL where it could not be computed."""
        return F.expr(self.guard(sql).sql)

    def holds(self, sql: str) -> Column:
        """The truth of a test; unknown counts as false."""
        return F.coalesce(self.value(sql).try_cast("boolean"), F.lit(False))

    def unmet(self, sql: str) -> Column:
        """Whether a test is false or unknown on a row that could be evaluated; the parts are looked at only where it has no value."""
        flags = self.guard(sql).flags
        return F.coalesce(~self.value(sql).try_cast("boolean"), ~F.expr(self.guard(sql).failed) if flags else F.lit(True))

    def failed(self, sql: str) -> Column:
        """Whether the row could not be evaluated: no value, because a part of it failed."""
        made = self.guard(sql)
        return self.value(sql).isNull() & F.expr(made.failed) if made.flags else F.lit(False)
