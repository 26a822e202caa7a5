"""Navigation between rows of a tree as joins on its keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.ordered import neighbours, running_last
from plumbline.plans.skew import skew_join


def child_axis(parents: DataFrame, children: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each child with its parent's columns; the parent side has one row per key."""
    return skew_join(children, parents, keys)


def ancestor_paths(path):
    """Proper ancestors of /a/b/c: /a and /a/b."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    top = F.size(parts) - 1
    return F.when(top > 0, F.transform(F.sequence(F.lit(1), F.greatest(top, F.lit(1))),
                                       lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))


def descendant_axis(nodes: DataFrame, doc: str, path: str, tops: DataFrame) -> DataFrame:
    """Nodes below the `tops` (doc, path). Every node offers its few ancestor paths, and equality
    finds the match, so no range or prefix join is needed."""
    each = nodes.withColumn("ancestor", F.explode(ancestor_paths(F.col(path))))
    top = tops.select(F.col(doc), F.col(path).alias("ancestor")).distinct()
    return skew_join(each, top, [doc, "ancestor"], "left_semi")


def ancestor_axis(nodes: DataFrame, doc: str, path: str, of: DataFrame) -> DataFrame:
    """Ancestors of the nodes `of` (doc, path)."""
    ups = of.select(doc, F.explode(ancestor_paths(F.col(path))).alias(path)).distinct()
    return nodes.join(ups, [doc, path], "left_semi")


def siblings(df: DataFrame, keys: Sequence[str], order: str, column: str, chunk_rows: int | None = None) -> DataFrame:
    return neighbours(df, keys, order, column, "previous", "following", chunk_rows)


def nearest_binding(nodes: DataFrame, decls: DataFrame, doc: str = "doc_id", path: str = "path", value: str = "value") -> DataFrame:
    """The value declared by the nearest ancestor-or-self; an empty text undeclares."""
    each = nodes.select(doc, path, F.explode(F.concat(F.coalesce(ancestor_paths(F.col(path)), F.array().cast("array<string>")),
                                                      F.array(F.col(path)))).alias("_at"))
    near = (skew_join(each, decls.select(doc, F.col(path).alias("_at"), value), [doc, "_at"])
            .groupBy(doc, path).agg(F.max_by(value, F.length("_at")).alias("binding")))
    return skew_join(nodes, near, [doc, path], "left").withColumn("binding", F.nullif(F.col("binding"), F.lit("")))


def binding_as_of(df: DataFrame, keys: Sequence[str], order: str, column: str, out: str = "binding",
                  chunk_rows: int | None = None) -> DataFrame:
    """The same along an order instead of a path: latest value at or before each row."""
    found = running_last(df, keys, order, column, out, chunk_rows)
    return found.withColumn(out, F.nullif(F.col(out), F.lit("")))
