"""The findings table: one attributed row per problem, whatever check produced it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from plumbline.plans.skew import skew_join, top_n_per_group

FIX = "struct<title:string,value:string,speculative:boolean>"
_TEXT = "source severity code doc_key row_key ordinal anchor column message technical pattern_id rule_id assertion_id".split()
SCHEMA = T.StructType(
    [T.StructField(n, T.LongType() if n == "ordinal" else T.StringType()) for n in _TEXT]
    + [T.StructField("fixes", T.ArrayType(T.StructType([
        T.StructField("title", T.StringType()), T.StructField("value", T.StringType()), T.StructField("speculative", T.BooleanType())])))])
SOURCES = ("well-formedness", "schema", "engine", "rules", "schema-health")
ANCHORS = ("element", "attribute", "text", "childGap")


def finding(**fields) -> list[Column]:
    """Select list for a findings frame; unnamed fields are NULL."""
    unknown = set(fields) - set(SCHEMA.names)
    if unknown:
        raise ValueError(f"not findings columns: {sorted(unknown)}")
    out = []
    for f in SCHEMA.fields:
        value = fields.get(f.name)
        col = value if isinstance(value, Column) else F.lit(value)
        out.append(col.cast(f.dataType).alias(f.name))
    return out


def key_text(*cols: str) -> Column:
    """Readable row key; NULL parts stay visible, and a separator or ∅ inside a value is escaped, so that keys never collide."""
    parts = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"([\\|∅])", r"\\$1"), F.lit("∅")) for c in cols]
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def doc_text(doc: str | Sequence[str] | None) -> Column | None:
    """The document a finding belongs to, by the columns that name it."""
    return None if doc is None else key_text(*([doc] if isinstance(doc, str) else doc))


def with_doc(key: Sequence[str], doc: str | Sequence[str] | None) -> list[str]:
    """Key columns and those that name the document, each once."""
    return list(dict.fromkeys([*key, *([] if doc is None else [doc] if isinstance(doc, str) else doc)]))


def union_findings(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack ragged tables; columns accumulate and absent ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_findings(findings: DataFrame, path: str, mode: str = "append") -> None:
    findings.write.mode(mode).partitionBy("source", "severity").parquet(path)


def counts_by_file(findings: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Errors and warnings per document, zero for a clean one."""
    per = findings.groupBy(F.col("doc_key").alias("_k")).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))
    keyed = docs.select(key).distinct().withColumn("_k", key_text(key))
    # one row per document on both sides
    return keyed.join(per, "_k", "left").select(
        key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("errors", "warnings")])


def verdict(findings: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """A document is valid when it has no finding of severity error. An error that names no document would be lost, so it ends the
    job: give the operators `doc`. Errors of the spec itself (schema-health) belong to none."""
    named = F.coalesce("doc_key", F.raise_error(F.concat(F.lit("a finding names no document: "), F.coalesce("code", "message", F.lit("?")))).cast("string"))
    bad = findings.where((F.col("severity") == "error") & (F.col("source") != "schema-health")).select(named.alias("_k")).distinct()
    keyed = docs.select(key).distinct().withColumn("_k", key_text(key))
    marked = keyed.join(bad.withColumn("_bad", F.lit(True)), "_k", "left")
    return marked.select(key, F.col("_bad").isNull().alias("valid"))


def verdict_delta(before: DataFrame, after: DataFrame, key: str = "doc_key") -> DataFrame:
    """What a change of spec or rules did to each document (both sides as counts_by_file gives)."""
    b = before.select(key, F.col("errors").alias("errors_before"), F.col("warnings").alias("warnings_before"))
    a = after.select(key, F.col("errors").alias("errors_after"), F.col("warnings").alias("warnings_after"))
    out = b.join(a, key, "full_outer")
    names = ["errors_before", "errors_after", "warnings_before", "warnings_after"]
    out = out.select(key, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    change = (F.when((F.col("errors_before") == 0) & (F.col("errors_after") > 0), "broke")
              .when((F.col("errors_before") > 0) & (F.col("errors_after") == 0), "fixed")
              .when(F.col("errors_before") == F.col("errors_after"), "same")
              .when(F.col("errors_after") > F.col("errors_before"), "worse").otherwise("better"))
    return out.withColumn("change", change)


def order_findings(findings: DataFrame) -> DataFrame:
    """Reader's order: document, position, then pattern."""
    return findings.orderBy("doc_key", "ordinal", "pattern_id", "rule_id", "assertion_id", "code")


def limit_per_document(findings: DataFrame, n: int = 500) -> DataFrame:
    """The first n findings of each document in document order (the list a reader is shown)."""
    order = [F.col(c) for c in ("ordinal", "pattern_id", "rule_id", "assertion_id", "code", "column", "row_key")]
    return top_n_per_group(findings, ["doc_key"], order, n)


def severity(role: Column) -> Column:
    return F.when(role == "warning", "warning").otherwise("error")


def rollup_worst(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Worst severity per node: of the node itself, and of everything inside it.

    `findings` carries `path` like /a/b/c; nodes carries `path`. Each finding is sent to all its
    ancestor paths and reduced map-side, so a deep or busy branch is never gathered.
    """
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    own = findings.groupBy("path").agg(F.max(rank).alias("rank")).where("path is not null")
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    ups = own.withColumn("_p", parts).select(
        "rank", F.size("_p").alias("_len"),
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_p")),
                                 lambda i: F.concat(F.lit("/"), F.array_join(F.slice("_p", 1, i), "/")))).alias("_i", "path"))
    worst = ups.groupBy("path").agg(
        F.max(F.when(F.col("_i") + 1 == F.col("_len"), F.col("rank"))).alias("here"),
        F.max(F.when(F.col("_i") + 1 < F.col("_len"), F.col("rank"))).alias("inside"))
    name = lambda c: F.when(F.col(c) == 2, "error").when(F.col(c) == 1, "warning").when(F.col(c) == 0, "info")
    return skew_join(nodes.select("path"), worst, ["path"], "left").select(
        "path", name("here").alias("here"), name("inside").alias("inside"))
