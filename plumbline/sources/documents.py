"""Documents in and out. Leaf values are read as text, so that lexical checks see what was written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from plumbline.functions.text import decode_entities, well_formed
from plumbline.operators.findings import finding, key_text

CORRUPT = "_corrupt_record"


def as_text(schema: T.DataType) -> T.DataType:
    """The same shape with every leaf a STRING."""
    if isinstance(schema, T.StructType):
        return T.StructType([T.StructField(f.name, as_text(f.dataType)) for f in schema.fields])
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(as_text(schema.elementType))
    return T.StringType()


def _schema(schema: str | T.StructType) -> T.StructType:
    return as_text(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def read_documents(spark: SparkSession, path: str | Sequence[str], row_tag: str, schema: str | T.StructType) -> DataFrame:
    """XML files to rows, one per `row_tag` element; unreadable ones keep their text in
    `_corrupt_record`, and every row knows its file."""
    full = _schema(schema).add(CORRUPT, T.StringType())
    df = (spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).schema(full).load(path))
    return df.withColumn("doc_id", F.col("_metadata.file_path"))


def read_document_lines(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """Files with one XML document on each line to rows. A document that does not parse spoils its own row only: its text is
    kept in `_corrupt_record`. (Files of `row_tag` elements end at the first of them.)"""
    rows = read_document_column(spark.read.text(path).withColumn("doc_id", F.col("_metadata.file_path")), "value", schema)
    return rows.select("record.*", "doc_id")


def read_document_column(df: DataFrame, col: str, schema: str | T.StructType, out: str = "record") -> DataFrame:
    """The same for documents held in a text column."""
    full = _schema(schema).add(CORRUPT, T.StringType())
    return df.withColumn(out, F.from_xml(F.col(col), full.simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))


def malformed(col: Column, format: str = "xml") -> Column:
    if format == "xml":
        return ~well_formed(col)
    if format == "json":
        parsed = F.from_json(col, T.StructType([T.StructField(CORRUPT, T.StringType())]),
                             {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        return parsed[CORRUPT].isNotNull() | ~F.coalesce(F.trim(col).rlike(r"(?s)\A[{\[].*[}\]]\z"), F.lit(False))
    raise ValueError("format is xml or json")


def quarantine_malformed(df: DataFrame, col: str, format: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows keep their text untouched and never fail the job. NULL counts as bad."""
    flag = F.coalesce(malformed(F.col(col), format), F.lit(True))
    return df.where(~flag), df.where(flag)


def malformed_findings(bad: DataFrame, col: str, key: Sequence[str]) -> DataFrame:
    return bad.select(*finding(source="well-formedness", severity="error", code="malformed", row_key=key_text(*key), doc_key=key_text(*key),
                               anchor="element", column=col, message="the text is not a well-formed document",
                               technical=F.substring(F.col(col), 1, 200)))


def root_name(col: Column) -> Column:
    """Local name of the first start tag, past comments, instructions and a doctype."""
    bare = F.regexp_replace(col, r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^\[>]*(?:\[[^\]]*\])?\s*>", "")
    return F.nullif(F.regexp_extract(bare, r"<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)", 1), F.lit(""))


def route_by_root(df: DataFrame, col: str, kinds: dict[str, str], other: str = "other") -> DataFrame:
    """Classify documents by root element, never by file name; write with partitionBy("kind")."""
    root = root_name(F.col(col))
    kind = None
    for name, k in kinds.items():
        kind = F.when(root == name, k) if kind is None else kind.when(root == name, k)
    out = df.withColumn("root", root)
    return out.withColumn("kind", F.lit(other) if kind is None else kind.otherwise(other))


def read_xsd_gated(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType, xsd: str) -> DataFrame:
    """A second verdict while reading: rows an XML schema refuses land in `_corrupt_record`. The
    schema file is shipped to the executors."""
    spark.sparkContext.addFile(xsd)  # every executor finds it by its name
    full = _schema(schema).add(CORRUPT, T.StringType())
    df = (spark.read.format("xml").option("rowTag", row_tag).option("rowValidationXSDPath", xsd.rsplit("/", 1)[-1])
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(full).load(path))
    # Spark refuses a scan that needs the corrupt column alone, so the verdict also touches a field
    field = next(f.name for f in full.fields if isinstance(f.dataType, T.StringType))
    return df.withColumn("valid", F.col(CORRUPT).isNull() & (F.coalesce(F.length(field), F.lit(0)) >= 0))


def to_xml_col(record: str | Column, row_tag: str = "record") -> Column:
    """A struct as XML text, escaped by Spark's writer."""
    return F.rtrim(F.to_xml(F.col(record) if isinstance(record, str) else record, {"rowTag": row_tag, "indent": ""}), F.lit("\n"))


def write_documents(df: DataFrame, path: str, root_tag: str = "documents", row_tag: str = "record", mode: str = "error") -> None:
    df.write.format("xml").option("rootTag", root_tag).option("rowTag", row_tag).mode(mode).save(path)
