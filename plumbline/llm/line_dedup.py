"""Line dedup by overlapping three-line windows.

Lines are what \n splits; lines without a word are passed over and stay. Three consecutive worded lines form a window; a
document with one or two has one window of them all. A window found earlier, in order of (doc_id, text hash, line), makes
its lines a repeat, and all lines that some repeat covers are removed. Null ids sort first; repeated rows (same id and
text) are one occurrence and keep or lose the same lines. Null texts stay null, texts without a removed line stay as they
are. All other columns are passed on; working columns get names that the input does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kit import fresh, keep
from plumbline.llm.quality_rules import let

WINDOW = 3


def _worded(text: Column) -> Column:
    """(line number, line) of lines with a word."""
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    return F.filter(numbered, lambda x: x["line"].rlike("[^\\x20\\x09-\\x0D]"))


def windows(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (id, text hash, first line k, 128-bit window hash) for each window."""

    def hashes(lines: Column) -> Column:
        last = F.greatest(F.size(lines) - WINDOW, F.lit(0))
        held = F.least(F.size(lines), F.lit(WINDOW))
        at = F.when(F.size(lines) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        parts = lambda k: [F.coalesce(F.get(lines, k + j)["line"], F.lit("")) for j in range(WINDOW)]
        return F.transform(at, lambda k: F.struct(
            k.alias("k"), F.xxhash64(held, *parts(k)).alias("h1"), F.xxhash64(F.lit(1), *parts(k), held).alias("h2")))

    found = docs.where(F.col(text).isNotNull()).select(
        F.col(id).alias("id"), F.xxhash64(text).alias("th"), F.explode(let(_worded(F.col(text)), hashes)).alias("w"))
    return found.select("id", "th", "w.k", "w.h1", "w.h2")


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text hash, k) of every window that was seen before. First places are combined per task before the exchange;
    the join that follows has plain exchanges on both sides, so that a window in a third of all documents is split."""
    seen = keep(windows(docs, id, text))
    place = F.struct("id", "th", "k")
    first = keep(seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                 .where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"))
    return seen.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("id", "th", "k")


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", removed: str = "n_removed") -> DataFrame:
    """Documents with repeated lines taken out, and how many were; `removed` replaces a column of that name."""
    th, starts, gone = fresh(docs, "_th"), fresh(docs, "_starts"), fresh(docs, "_gone")
    rep_id = fresh(docs, "_rep_id")
    lost = (repeats(docs, id, text).groupBy("id", "th").agg(F.sort_array(F.collect_set("k")).alias(starts))
            .select(F.col("id").alias(rep_id), F.col("th").alias(th), starts))
    keyed = docs.drop(removed) if removed in docs.columns else docs
    joined = keyed.join(lost, F.col(id).eqNullSafe(F.col(rep_id)) & (F.xxhash64(text) == F.col(th)), "left")

    def numbers(lines: Column) -> Column:
        ranks = F.flatten(F.transform(F.col(starts), lambda k: F.sequence(k, F.least(k + (WINDOW - 1), F.size(lines) - 1))))
        return F.transform(F.array_distinct(ranks), lambda p: F.get(lines, p)["i"])

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    cut = joined.withColumn(gone, F.when(F.col(starts).isNotNull(), let(_worded(F.col(text)), numbers)))
    out = cut.withColumn(text, F.when(F.col(gone).isNotNull(), let(F.split(text, "\n"), rest)).otherwise(F.col(text)))
    count = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone))
    return out.withColumn(removed, count.cast("long")).select(*keyed.columns, removed)


def with_rest(cut: DataFrame, columns: list[str], removed: str = "n_removed", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The given columns of documents that still have a word or lost nothing, with the character count brought up to date."""
    alive = (F.col(removed) == 0) | F.col(text).rlike("[^\\x20\\x09-\\x0D]")
    if chars in columns:
        cut = cut.withColumn(chars, F.when(F.col(removed) > 0, F.length(text).cast(cut.schema[chars].dataType)).otherwise(F.col(chars)))
    return cut.where(alive).select(*columns)
