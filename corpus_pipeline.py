"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontamination, jaccard_join, line_dedup, packing, quality_rules
from plumbline.llm.kit import shared_folder
from plumbline.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1 of the rule ledger."""
    return quality_rules.keep_good(docs, "v1")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three-line windows go; n_chars follows the text; documents left without a word go too."""
    cut = line_dedup.remove_repeats(docs, removed="_n_removed")
    return line_dedup.with_rest(cut, docs.columns, removed="_n_removed")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard_join.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens."""
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_copies),
          ("decontamination", leaks), ("packing", sequences)]

#: Packing and substitution-tolerant overlaps are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
