"""The registered queries of the text operators: whole tables in, digest columns out, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (best_fit_packing, context_tree, decontamination, fill_in_middle, jaccard_join, language_id, license_scan, line_dedup, packing,
                           quality_classifier, quality_rules, sharding, vector_codes)
from plumbline.llm.kit import crc_mod
from plumbline.llm.sql import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    found = language_id.identify(docs, docs.where(crc_mod("doc_id", 3) != 1))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "phrase_rate")


@query
def op2_lm_scoring(spark, sf):
    docs = table(spark, sf, "documents")
    scored = context_tree.score(docs, crc_mod("doc_id", 5) != 1)
    return scored.withColumn("held_out", crc_mod("doc_id", 5) == 1)


@query
def op3_sharding(spark, sf):
    docs = table(spark, sf, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                       F.xxhash64("text").alias("group"))
    out = sharding.shard(rows, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path(), with_ids=False)


@query
def op5_line_dedup(spark, sf):
    out = line_dedup.remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_removed", "text")


@query
def op6_decontamination(spark, sf):
    return decontamination.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_quality_rules(spark, sf):
    entries = quality_rules.ledger(table(spark, sf, "documents"))
    judged = quality_rules.apply_policy(quality_rules.apply_policy(entries, "base", "base_passed"), "v1")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         (~F.col("base_passed")).alias("base_failed"), "kept", "failed_rules")


@query
def op9_jaccard_join(spark, sf):
    return jaccard_join.components(table(spark, sf, "documents"))


#: Where the documents stand in a tree of directories: most in the third level, some nearer to their source.
PATH = ("concat(source, '/', case when doc_id % 100 = 0 then '' when doc_id % 10 = 0 then concat(cast(doc_id div 1000 as string), '/') "
        "else concat(cast(doc_id div 1000 as string), '/', cast(doc_id div 100 as string), '/') end, cast(doc_id as string), '.txt')")


@query
def op7_license_scan(spark, sf):
    return license_scan.scan(table(spark, sf, "documents").withColumn("path", F.expr(PATH)))


@query
def op10_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality_classifier.learn(docs, table(spark, sf, "labels"), crc_mod("doc_id", 5) != 0)
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op13_fill_in_middle(spark, sf):
    stored = fill_in_middle.store(table(spark, sf, "documents"))
    return fill_in_middle.infill(stored, with_frames=False)


@query
def op12_vector_codes(spark, sf):
    coded, books = vector_codes.learn(table(spark, sf, "embeddings"))
    out = vector_codes.label_errors(coded).withColumn("codebooks_sha256", F.lit(vector_codes.codebooks_digest(books)))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


@query
def op11_best_fit_packing(spark, sf):
    return best_fit_packing.pack(table(spark, sf, "documents"), tokenizer_path(), with_ids=False)
