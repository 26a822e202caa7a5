"""Enumerations and suggestions against a vocabulary held as a table of any size.

A value is looked up once however often it occurs: distinct values meet the vocabulary in one exact join, and only rows
whose value passes a bit filter of fixed size are exchanged to be reported. The nearest word is found through an index of
deletion neighbourhoods: two texts at most d edits apart share a text that each becomes by dropping at most d characters.
Neighbourhoods are searched for one edit first, then two, then three, each for the names still without an answer, so the
large ones (about n^3 / 6 texts of a word of n characters) are made only where they are needed, and only of texts whose
length the other side has within those edits. NULL values are not
checked and get no suggestion; an empty vocabulary lists nothing; of equally near words the smallest is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import normalize_space, strip
from plumbline.operators.findings import FIX, finding, key_text
from plumbline.plans.lineage import cut
from plumbline.plans.skew import skew_join

#: Words of 64 bits in a filter: 2^20 bits, 128 KB, whatever it holds. A full filter lets everything pass.
FILTER_WORDS = 1 << 14


def vocabulary(df: DataFrame, col: str, white_space: str = "preserve") -> DataFrame:
    """The distinct values of a column as (word)."""
    return df.select(normalize_space(F.col(col).cast("string"), white_space).alias("word")).where("word is not null").distinct()


def bit_filter(hashes: DataFrame, col: str) -> Column:
    """A scalar holding one bit for each hash of a column, for `may_hold`."""
    bits = hashes.select(F.pmod(col, F.lit(FILTER_WORDS * 64)).alias("_slot")).groupBy(F.expr("shiftright(_slot, 6)").alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 as int))")).alias("_bits"))
    dense = hashes.sparkSession.range(FILTER_WORDS).join(bits, "id", "left").select("id", F.coalesce("_bits", F.lit(0)).alias("_bits"))
    held = F.array_sort(F.collect_list(F.struct("id", "_bits")))  # FILTER_WORDS entries
    return dense.agg(F.transform(held, lambda w: w["_bits"])).scalar()


def may_hold(bits: Column, hashed: Column) -> Column:
    """False only where the hash is surely not in the filter."""
    slot = F.pmod(hashed, F.lit(FILTER_WORDS * 64))
    return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def near_enough(name: Column, word: Column) -> Column:
    """Edits that a misspelt name may have: a third of the longer text, at least one."""
    return F.greatest(F.lit(1), F.floor(F.greatest(F.length(name), F.length(word)) / 3).cast("int"))


def _one_less(texts: Column) -> Column:
    """Every text that one of `texts` becomes by dropping one character."""
    without = lambda t: F.when(F.length(t) > 0, F.transform(
        F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.coalesce(without(t), F.array().cast("array<string>")))))


def _neighbourhood(df: DataFrame, text: str, edits: int) -> DataFrame:
    """(text, _key): hashes of what the text becomes by dropping up to `edits` characters. Hashes that meet by chance
    only add candidates."""
    levels = [f"_d{k}" for k in range(edits + 1)]
    df = df.withColumn(levels[0], F.array(F.lower(text)))
    for before, now in zip(levels, levels[1:]):
        df = df.withColumn(now, _one_less(F.col(before)))
    return df.select(text, F.explode(F.concat(*levels)).alias("_key")).select(text, F.xxhash64("_key").alias("_key"))


def _of_a_length(df: DataFrame, text: str, other: DataFrame, named: str, edits: int) -> DataFrame:
    """Rows whose text is at most `edits` characters longer or shorter than some text of the other side: no other can be that near.
    The lengths that occur are one array."""
    lengths = other.agg(F.collect_set(F.length(F.lower(named)))).scalar()
    own = F.length(F.lower(text))
    return df.where(F.arrays_overlap(lengths, F.sequence(own - edits, own + edits)))


def nearest_words(names: DataFrame, name: str, words: DataFrame, edits: int = 3,
                  allowed: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(name, word, edits): the nearest word, without regard to case, of each distinct name that has one within `edits`
    and, if given, `allowed(name, word)` edits. The name column is not called word or edits."""
    return _nearest(names, name, words, edits, allowed).withColumnRenamed("_name", name)


def _nearest(names: DataFrame, name: str, words: DataFrame, edits: int, allowed: Callable[[Column, Column], Column] | None) -> DataFrame:
    words = cut(words.select("word").where("word is not null").distinct())
    left = cut(_of_a_length(names.select(F.col(name).alias("_name")).where("_name is not null").distinct(), "_name", words, "word", edits))
    found = left.select("_name", F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("edits")).limit(0)
    for most in range(edits + 1):
        asked = _neighbourhood(_of_a_length(left, "_name", words, "word", most), "_name", most)
        bits = bit_filter(asked, "_key")
        offered = _neighbourhood(_of_a_length(words, "word", left, "_name", most), "word", most).where(may_hold(bits, F.col("_key")))
        apart = F.levenshtein(F.lower("_name"), F.lower("word"), most)
        pairs = asked.join(offered, "_key").select("_name", "word", apart.alias("edits")).where("edits >= 0")
        if allowed is not None:
            pairs = pairs.where(F.col("edits") <= allowed(F.col("_name"), F.col("word")))
        best = cut(pairs.groupBy("_name").agg(F.min(F.struct("edits", "word")).alias("_b")).select("_name", "_b.word", "_b.edits"))
        found = found.unionByName(best)
        if most < edits:
            left = cut(left.join(best, "_name", "left_anti"))
            if left.isEmpty():
                break
    return found


def suggest(df: DataFrame, name: str, words: DataFrame, out: str = "suggestion", edits: int = 3) -> DataFrame:
    """The listed word that each row's name was probably meant to be, else NULL; distinct names are searched once."""
    near = _nearest(df, name, words, edits, near_enough).select(F.col("_name").alias(name), F.col("word").alias(out))
    return skew_join(df, near, [name], "left")


def _fixes(bad: DataFrame, words: DataFrame) -> DataFrame:
    """(_value, fixes) for unlisted values: the word of the same letters, which is no guess, else the nearest one."""
    near = nearest_words(bad.select(strip(F.col("_value")).alias("_trimmed")), "_trimmed", words)
    same = F.col("edits") == 0
    title = F.concat(F.when(same, "spelling of the list: ").otherwise("nearest listed value: "), F.col("word"))
    fix = F.array(F.struct(title.alias("title"), F.col("word").alias("value"), (~same).alias("speculative"))).cast(f"array<{FIX}>")
    joined = bad.withColumn("_trimmed", strip(F.col("_value"))).join(near, "_trimmed", "left")
    return joined.select("_value", F.when(F.col("word").isNotNull(), fix).otherwise(F.array().cast(f"array<{FIX}>")).alias("fixes"))


def check_vocabulary(df: DataFrame, col: str, words: DataFrame, key: Sequence[str], doc: str | None = None, white_space: str = "preserve",
                     fixes: bool = False) -> DataFrame:
    """Findings for the rows whose value is not a word of the vocabulary."""
    valued = df.withColumn("_value", normalize_space(F.col(col).cast("string"), white_space))
    listed = words.select(F.col("word").alias("_value"))
    bad = cut(valued.where("_value is not null").select("_value").distinct().join(listed, "_value", "left_anti"))
    bits = bit_filter(bad.select(F.xxhash64("_value").alias("_hash")), "_hash")
    suspects = valued.where(F.col("_value").isNotNull() & may_hold(bits, F.xxhash64("_value")))
    rows = skew_join(suspects, _fixes(bad, words).withColumnRenamed("fixes", "_fixes") if fixes else bad.withColumn("_fixes", F.lit(None)), ["_value"])
    return rows.select(*finding(
        source="schema", severity="error", code="cvc-enumeration-valid", row_key=key_text(*key), doc_key=key_text(doc) if doc else None, anchor="text",
        column=col, message=F.concat(F.lit(f"{col}: "), F.col("_value"), F.lit(" is not a listed value")), fixes=F.col("_fixes")))
