"""Scalar text functions, all built from Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The XML name classes (Basic Multilingual Plane) and the predefined entities, white space.
NAME_START = (r":A-Z_a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}"
              r"\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}")
NAME_EXTRA = r"\-.0-9\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}"
WHITESPACE = " \t\n\x0b\f\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ENTITIES = {"lt": "<", "gt": ">", "apos": "'", "quot": '"'}
REFERENCE = r"(?:#x[0-9a-fA-F]+|#[0-9]+|[A-Za-z_:][A-Za-z0-9_.:\-]*)"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(col, F.lit(WHITESPACE))


def normalize_space(col: Column, mode: str = "collapse") -> Column:
    """preserve; replace (tab, LF, CR become spaces); collapse (also trim and squeeze)."""
    if mode == "preserve":
        return col
    flat = F.translate(col, "\t\n\r", "   ")
    if mode == "replace":
        return flat
    if mode != "collapse":
        raise ValueError(f"unknown whitespace mode {mode}")
    return F.regexp_replace(F.trim(flat), " {2,}", " ")


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def humanise(col: Column) -> Column:
    """shipDate, ship_date, SHIP-DATE -> "Ship date"; an acronym inside a name keeps its capitals."""
    words = F.filter(F.split(col, r"[_\-\s]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"), lambda w: w != "")
    acronym = lambda w: col.rlike(r"\p{Ll}") & w.rlike(r"\A[\p{Lu}\d]{2,}\z")
    title = F.array_join(F.transform(words, lambda w: F.when(acronym(w), w).otherwise(F.lower(w))), " ")
    return F.when(F.size(words) == 0, col).otherwise(F.concat(F.upper(F.left(title, F.lit(1))), F.substr(title, F.lit(2))))


def decode_entities(col: Column) -> Column:
    """Resolve predefined and numeric character references; unknown ones stay as written.

    The text is cut at its references; each piece after a cut starts with one reference body, so a
    decoded character can never combine with what follows into a new reference.
    """
    pieces = F.split(col, f"&(?={REFERENCE};)")
    def resolve(piece: Column) -> Column:
        body = F.substring_index(piece, ";", 1)
        rest = F.substring(piece, F.length(body) + F.lit(2), F.length(piece))
        digits = (F.when(body.rlike(r"\A#x0*[0-9a-fA-F]{1,6}\z"), F.conv(F.regexp_extract(body, "#x0*([0-9a-fA-F]+)", 1), 16, 10))
                  .when(body.rlike(r"\A#0*[0-9]{1,7}\z"), F.regexp_extract(body, "#0*([0-9]+)", 1)))
        code = digits.try_cast("int")
        # the code point as four big-endian octets
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        usable = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        named = F.when(body == "amp", F.lit("&"))
        for name, text in ENTITIES.items():
            named = named.when(body == name, F.lit(text))
        numeric = F.when(F.substring(body, 1, 1) == "#", F.when(usable, char))
        return F.coalesce(F.concat(F.coalesce(named, numeric), rest), F.concat(F.lit("&"), piece))
    decoded = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(resolve(p))), "")
    return F.when(F.contains(col, F.lit("&")), decoded).otherwise(col)


def encode_text(col: Column) -> Column:
    """Escape for element content; an ampersand that already starts a reference is left alone."""
    amp = F.regexp_replace(col, f"&(?!{REFERENCE};)", "&amp;")
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def encode_attribute(col: Column, quote: str = '"') -> Column:
    out = F.replace(F.regexp_replace(col, f"&(?!{REFERENCE};)", "&amp;"), F.lit("<"), F.lit("&lt;"))
    for raw, ref in (("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(raw), F.lit(ref))
    return F.replace(out, F.lit(quote), F.lit("&quot;" if quote == '"' else "&apos;"))


def normalise_attribute(col: Column) -> Column:
    """Literal line ends and tabs become one space each, then references are decoded."""
    return decode_entities(F.regexp_replace(col, "\r\n|[\t\n\r]", " "))


def valid_name(col: Column) -> Column:
    return col.rlike(rf"\A[{NAME_START}][{NAME_START}{NAME_EXTRA}]*\z")


def text_preview(col: Column, limit: int = 48) -> Column:
    text = strip(col)
    return (F.when(text == "", None)
            .when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text))


def strip_namespaces(col: Column) -> Column:
    """Drop xmlns declarations and the prefixes of tags and attributes; text between tags is left alone."""
    surplus = r"""\sxmlns(?::[\w.-]+)?=(?:"[^"]*"|'[^']*')|(?<=<|</)[\w.-]+:|(?<=\s)[\w.-]+:(?=[\w.-]+=)"""

    def in_tag(piece: Column) -> Column:
        end = F.instr(piece, ">")
        return F.concat(F.regexp_replace(F.left(piece, end), surplus, ""), F.substr(piece, end + 1))

    pieces = F.split(col, "(?=<)")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("<"), in_tag(p)).otherwise(p)), "")


def _fold_path(path: Column) -> Column:
    """Without empty, '.' and '..' steps. Read from the end: each '..' takes away the next name before it, if there is one."""
    names = F.filter(F.reverse(F.split(path, "/")), lambda s: ~s.isin("", "."))

    def take(acc: Column, s: Column) -> Column:
        gone = (s != "..") & (acc["up"] > 0)
        kept = F.when((s == "..") | gone, acc["kept"]).otherwise(F.concat(F.array(s), acc["kept"]))
        return F.struct((acc["up"] + F.when(s == "..", 1).when(gone, -1).otherwise(0)).alias("up"), kept.alias("kept"))

    start = F.struct(F.lit(0).alias("up"), F.array().cast("array<string>").alias("kept"))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(names, start, take)["kept"], "/"))


def resolve_uri(loc: Column, base: Column) -> Column:
    """A location against a base: absolute stays, rooted keeps the authority, else same directory."""
    scheme = r"\A[A-Za-z][A-Za-z0-9+.\-]*:"
    authority = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_path = F.regexp_replace(F.substr(base, F.length(authority) + 1), r"[?#].*\z", "")
    directory = F.regexp_extract(base_path, r"\A(.*/)", 1)
    directory = F.when((authority != "") & (directory == ""), "/").otherwise(directory)
    suffix = F.regexp_extract(loc, r"([?#].*)\z", 1)
    path = F.regexp_replace(loc, r"[?#].*\z", "")
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(directory, path))
    tail = F.when((authority != "") & (joined.rlike(r"(/|/\.{1,2})\z")) & (_fold_path(joined) != "/"), "/").otherwise("")
    return F.when(loc.rlike(scheme), loc).otherwise(F.concat(authority, _fold_path(joined), tail, suffix))


def edit_distance(a: Column, b: Column, threshold: int | None = None) -> Column:
    """Levenshtein distance; with a threshold, -1 where it is exceeded."""
    return F.levenshtein(a, b) if threshold is None else F.levenshtein(a, b, threshold)


def well_formed(col: Column) -> Column:
    """Whether a text is one well-formed XML document.

    Spark's parser checks nesting and attributes but stops at the end of the first element, so the
    number of top-level elements is counted from the tags.
    """
    bare = F.regexp_replace(col, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^\[>]*(?:\[[^\]]*\])?\s*>", "")
    bare = strip(bare)
    move = lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1)

    def one_root(text: Column) -> Column:
        tags = F.regexp_extract_all(text, F.lit(r"""<(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>"""), F.lit(0))
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("tops"))
        walk = F.aggregate(tags, start, lambda acc, t: F.struct(
            (acc["depth"] + move(t)).alias("depth"), (acc["tops"] + F.when(acc["depth"] == 0, 1).otherwise(0)).alias("tops")))
        return text.startswith("<") & text.endswith(">") & (walk == F.struct(F.lit(0).alias("depth"), F.lit(1).alias("tops")))

    parsed = F.from_xml(col, "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(col.isNotNull(), let(bare, one_root) & parsed["_bad"].isNull())


def xpath_value(col: Column, expr: str, kind: str = "string") -> Column:
    """XPath 1.0 over an XML text column; NULL instead of a failed job where the text is not XML."""
    return xpath_values(col, {"v": (expr, kind)})["v"]


def xpath_values(col: Column, wanted: dict[str, tuple[str, str]]) -> Column:
    """Several expressions {name: (XPath, kind)} over one text as a struct, checked once."""
    fn = {"string": F.xpath_string, "boolean": F.xpath_boolean, "number": F.xpath_number, "nodes": F.xpath}
    return F.when(well_formed(col), F.struct(*[fn[kind](col, F.lit(expr)).alias(name) for name, (expr, kind) in wanted.items()]))
