"""Rule bitmask ledger: every rule is evaluated once, its bit and measurements are stored, policies read the bits.

DataFrame functions only. A null or empty text has no words and fails `too_few_words`. Rows are never merged: repeated
rows give repeated ledger rows. Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rules in the order of their bits: true means the document fails. Each reads measurements by name.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "too_few_words": lambda m: m("n_words") < 20,
    "repeated_words": lambda m: 100 * m("n_repeat_words") > 30 * m("n_words"),
    "many_symbols": lambda m: 10 * m("n_symbols") > 2 * m("n_words"),
    "shouting": lambda m: 2 * m("n_capitals") > m("word_chars"),
    "many_marks": lambda m: 4 * m("n_marks") > 3 * m("n_words"),
    "repeated_lines": lambda m: 5 * m("n_dup_lines") > 3 * m("n_lines"),
    "doubled_words": lambda m: 10 * m("n_doubled") > 3 * m("n_words"),
    "odd_word_length": lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words")),
}

#: Policies name the rules they apply. A published version is never changed; a new one is added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": tuple(RULES),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def chars_of(text: Column, chars: str) -> Column:
    """How many characters of a set a text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a window of eight words which occurs twice or more in the text."""

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                                 | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        several = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(several, let(let(pairs, positions), length)).otherwise(F.lit(0))

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        return F.transform(at, lambda i: F.xxhash64(*[hashes[i + (j - 1)] for j in range(WINDOW)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, let(let(hashed, windows), covered)).otherwise(F.lit(0))


def facts(text: Column) -> Column:
    """All measurements of a text as one struct, each part of the text split once."""
    t = F.coalesce(text, F.lit(""))
    line_facts = let(worded_lines(text), lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    numbers = lambda w, x: {
        "n_words": F.size(w), "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")), "n_symbols": chars_of(t, SYMBOLS),
        "n_dup_lines": x["n_dup_lines"], "n_repeat_words": repeated_window_words(w), "n_lines": x["n_lines"],
        "n_capitals": chars_of(t, CAPITALS), "n_marks": chars_of(t, "!?"),
        "n_doubled": F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))}
    return let(line_facts, lambda x: let(split_words(text), lambda w: F.struct(
        *[v.cast("long").alias(k) for k, v in numbers(w, x).items()])))


def bits_of(m: Callable[[str], Column], rules: dict = RULES) -> Column:
    flags = [F.when(rule(m), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(rules.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), flags)


def ledger(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: dict = RULES) -> DataFrame:
    """Measurements with one long `failed_rules`: bit k is set where rule k fails. One pass, no exchange."""
    measured = docs.select(F.col(id), facts(F.col(text)).alias("_facts")).select(id, "_facts.*")
    return measured.withColumn("failed_rules", bits_of(F.col, rules))


def mask(policy: str, rules: dict = RULES) -> int:
    order = list(rules)
    return sum(1 << order.index(name) for name in POLICIES[policy])


def apply_policy(entries: DataFrame, policy: str, out: str = "kept") -> DataFrame:
    """Verdict of a policy from the stored bits; no text is read again."""
    return entries.withColumn(out, F.col("failed_rules").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str, rules: dict = RULES) -> DataFrame:
    """Per rule of a policy: documents failing it, failing nothing else, and kept if the rule were dropped."""
    bit = mask(policy)
    counts = entries.groupBy(F.col("failed_rules").bitwiseAND(F.lit(bit)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = [F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit"))
            for k, name in enumerate(rules) if bit >> k & 1]
    rows = counts.withColumn("r", F.explode(F.array(*each)))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return rows.groupBy("r.rule").agg(
        total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
        total(F.col("bits") == F.col("r.bit")).alias("failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without"))


def keep_good(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """Documents that pass a policy, with all their columns; the bits are computed beside the row, without a join."""
    bits = let(facts(F.col(text)), lambda m: bits_of(lambda name: m[name]))
    return docs.where(bits.bitwiseAND(F.lit(mask(policy))) == 0)
