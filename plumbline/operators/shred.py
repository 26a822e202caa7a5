"""Between nested records, node rows and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from plumbline.plans.ordered import CHUNK, row_numbers, with_chunks
from plumbline.plans.skew import skew_join

NODE = ("struct<position:array<int>,path:string,parent_path:string,name:string,ordinal:int,depth:int,"
        "value:string,attrs:map<string,string>>")
ATTRIBUTE_PREFIX, TEXT_FIELD = "_", "_VALUE"
MAX_COLUMNS = 10_000


def _join(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def _nodes(value: Column, kind: T.DataType, name: str, path: str, parent: str, place: Column, ordinal: Column, depth: int) -> Column:
    """Array of node structs for one value, in document order."""
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda v, i: _nodes(v, kind.elementType, name, path, parent,
                                                     _join(place, F.array(i + 1)), i + 1, depth))
        return F.coalesce(F.flatten(each), F.array().cast(f"array<{NODE}>"))
    attrs, text, children = F.lit(None).cast("map<string,string>"), F.lit(None).cast("string"), []
    if isinstance(kind, T.StructType):
        marked = [f.name for f in kind.fields if f.name.startswith(ATTRIBUTE_PREFIX) and f.name != TEXT_FIELD]
        if marked:
            pairs = F.array(*[F.struct(F.lit(m[1:]).alias("key"), value[m].cast("string").alias("value")) for m in marked])
            attrs = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
        if TEXT_FIELD in kind.fieldNames():
            text = value[TEXT_FIELD].cast("string")
        number = 0
        for f in kind.fields:
            if f.name.startswith(ATTRIBUTE_PREFIX):
                continue
            number += 1
            at = _join(place, F.array(F.lit(number)))
            inner = at if isinstance(f.dataType, T.ArrayType) else _join(at, F.array(F.lit(1)))
            children.append(_nodes(value[f.name], f.dataType, f.name, f"{path}/{f.name}", path, inner, F.lit(1), depth + 1))
    else:
        text = value.cast("string")
    own = F.struct(place.alias("position"), F.lit(path).alias("path"), F.lit(parent).alias("parent_path"), F.lit(name).alias("name"),
                   ordinal.alias("ordinal"), F.lit(depth).alias("depth"), text.alias("value"), attrs.alias("attrs"))
    made = F.concat(F.array(own).cast(f"array<{NODE}>"), *children) if children else F.array(own).cast(f"array<{NODE}>")
    return F.when(value.isNotNull(), made).otherwise(F.array().cast(f"array<{NODE}>"))


def shred(df: DataFrame, col: str, keys: Sequence[str], root: str | None = None) -> DataFrame:
    """One row per node of a nested column: position (ordinals from the root), name path, ordinal,
    depth, own text and attributes. One pass over the rows, however many paths the schema has."""
    root = root or col
    nodes = _nodes(F.col(col), df.schema[col].dataType, root, f"/{root}", "", F.array(F.lit(1)), F.lit(1), 1)
    return df.select(*keys, F.posexplode(nodes).alias("node_ix", "_n")).select(*keys, "node_ix", "_n.*")


def document_order(nodes: DataFrame) -> DataFrame:
    """A sortable text for pre-order positions; attributes can append to it to sort just after."""
    key = F.array_join(F.transform("position", lambda p: F.lpad(p.cast("string"), 10, "0")), ".")
    return nodes.withColumn("order_key", key)


def attributes(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attribute rows, namespace declarations left out."""
    rows = nodes.select(*keys, "path", "node_ix", F.explode("attrs").alias("attribute", "value"))
    return rows.where(~F.col("attribute").rlike(r"\Axmlns(:|\z)"))


def text_of(df: DataFrame, keys: Sequence[str], order: str, text: str, chunk_rows: int | None = None, sep: str = "") -> DataFrame:
    """Text parts of each parent joined in order. A parent with more parts than a chunk holds comes
    as several rows, numbered by `part`; every other parent has the single part 0."""
    chunked, _ = with_chunks(df, keys, order, chunk_rows)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))["t"]
    out = chunked.groupBy(*keys, CHUNK).agg(F.array_join(parts, sep).alias("text"))
    return out.select(*keys, F.col(CHUNK).alias("part"), "text")


def largest_repeated_group(df: DataFrame, parent: Sequence[str], name: str, order: str) -> DataFrame:
    """Per parent, the child name repeated most (twice at least); the first seen wins a tie."""
    counts = df.groupBy(*parent, name).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")).where("_n >= 2")
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f"), F.col(name).alias("name")))
    return counts.groupBy(*parent).agg(best.alias("_b")).select(*parent, F.col("_b.name").alias(name), (-F.col("_b.n")).alias("rows"))


def column_names(cells: DataFrame, name: str) -> list[str]:
    """Names that become columns: a schema-sized list, collected to plan the table."""
    names = [r[0] for r in cells.select(name).distinct().where(F.col(name).isNotNull()).limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} different names: these are values, not columns")
    return sorted(names)


def repeated_to_table(cells: DataFrame, row: Sequence[str], name: str, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Long cells to a wide table, one row per repeated record; attribute cells are named @x, absent
    cells are NULL, and columns are collected over all rows."""
    columns = list(columns) if columns is not None else column_names(cells, name)
    picks = [F.max(F.when(F.col(name) == c, F.col(value))).alias(c) for c in columns]
    return cells.groupBy(*row).agg(*picks)


def outline(df: DataFrame, parent: Sequence[str], name: str, order: str, has_children: Column | None = None,
            text: str | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Ordinal k of n among same-named siblings; rows that are only blank text are left out."""
    rows = df.where(~(F.col(name).isNull() & (F.trim(F.col(text)) == ""))) if text else df
    numbered = row_numbers(rows, [*parent, name], order, "ordinal", chunk_rows)
    sizes = rows.groupBy(*parent, name).agg(F.count(F.lit(1)).alias("siblings"))
    out = skew_join(numbered, sizes, [*parent, name], "left")
    single = F.col(name).isNull()  # a row without a name has no same-named siblings
    out = out.withColumns({c: F.when(single, F.lit(1).cast("long")).otherwise(F.col(c)) for c in ("ordinal", "siblings")})
    return out.withColumn("has_children", has_children) if has_children is not None else out


def is_mixed(nodes: DataFrame, parent: Sequence[str], is_text: Column, text: str) -> DataFrame:
    """Parents that hold both non-blank text and elements."""
    return nodes.groupBy(*parent).agg(
        (F.bool_or(is_text & F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))) & F.bool_or(~is_text)).alias("mixed"))
