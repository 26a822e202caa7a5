"""Benchmark decontamination by spaced seeds.

Four fixed masks of five compared words are laid at every word. Whichever three of twelve words are replaced, one of the
masks lies inside the twelve words on equal words only, so every window the check accepts holds a seed (the tests go
through all placements). Seeds of the benchmark are also set in a bitmap of fixed size, which goes to every task; a document's seeds that
miss it are dropped where they are made, the few others are joined with the benchmark's seeds. Around each meeting the
two word sequences are compared along their common diagonal: twelve-word windows with at least nine equal words are an
overlap. Items shorter than the mask are looked for as a whole, without ignored positions.

Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased. Null, empty and wordless texts and items match nothing. Equal item texts are
compared once and reported under each of their ids; repeated documents are reported each by their id (one row per id).
Other columns are not read by `overlaps`; `drop_leaks` passes all columns on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kit import U, bitmap, fresh, keep, mix, passes, slices

#: Fixed masks: 1 is compared, 0 is ignored. Together they meet every window of SPAN words with ENOUGH equal ones; other values of those need other masks.
MASKS = ("110111", "110001011", "1110100001", "100000011011")
SPAN = 12
ENOUGH = 9
FILTER_BITS = 24


def _seeds(words: np.ndarray, left: np.ndarray, short: list[int], size: np.ndarray, items: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes and the word each begins at. left: words from here to the document's end. short: lengths of short items;
    size: number of words of the whole text; of items, only whole short ones are hashed."""
    n, out, at = len(words), [], []
    where = np.arange(n)
    with np.errstate(over="ignore"):
        for k, mask in enumerate(MASKS):
            ok = where[(left >= len(mask)) & (size >= SPAN)]
            total = np.full(len(ok), U(k + 1))
            for j, bit in enumerate(mask):
                if bit == "1":
                    total += words[ok + j] * U(2 * j + 3) * U(0x9E3779B97F4A7C15)
                    total ^= total >> U(29)
            out.append(mix(total))
            at.append(ok)
        for length in short:
            ok = where[(size == length) & (left == length)] if items else where[left >= length]
            total = np.full(len(ok), U(1000 + length))
            for j in range(length):
                total = mix(total + words[ok + j] * U(2 * j + 3))
            out.append(total)
            at.append(ok)
    return np.concatenate(out), np.concatenate(at)


def _doc_words(texts):
    start, end, before = texts.words()
    return texts.hashes(start, end), before


def benchmark_seeds(items: DataFrame, short: list[int], id: str, text: str) -> DataFrame:
    """(seed, item, place, words) for each seed of each item."""

    def run(batches):
        for texts in slices(batches):
            words, before = _doc_words(texts)
            n = np.diff(before)
            doc = np.repeat(np.arange(len(texts)), n)
            left = before[1:][doc] - np.arange(len(words))
            seed, at = _seeds(words, left, short, n[doc], items=True)
            yield pa.RecordBatch.from_pydict({"seed": seed.view(np.int64), "item": texts.ids("id").take(pa.array(doc[at])),
                                              "place": at - before[doc[at]]})

    kind = items.schema[id].dataType.simpleString()
    return items.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"seed long, item {kind}, place long")


def _words_table(items: DataFrame, id: str, text: str) -> DataFrame:
    def run(batches):
        for texts in slices(batches):
            words, before = _doc_words(texts)
            lists = pa.LargeListArray.from_arrays(pa.array(before.astype(np.int64)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([texts.ids("id"), lists.cast(pa.list_(pa.int64()))], ["item", "item_words"])

    kind = items.schema[id].dataType.simpleString()
    return items.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"item {kind}, item_words array<long>")


def _stretches(docs: DataFrame, flags: np.ndarray, short: list[int], reach: int, id: str, text: str) -> DataFrame:
    """Stretches of documents around seeds that pass the bitmap: (id, base, words, seeds, places)."""
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def run(batches):
        bits = np.unpackbits(held.value).astype(bool)
        for texts in slices(batches):
            words, before = _doc_words(texts)
            n = np.diff(before)
            doc = np.repeat(np.arange(len(texts)), n)
            left = before[1:][doc] - np.arange(len(words))
            seed, at = _seeds(words, left, short, n[doc])
            ok = passes(bits, seed)
            seed, at = seed[ok], at[ok]
            order = np.argsort(at, kind="stable")
            seed, at = seed[order], at[order]
            if not len(at):
                continue
            cut = np.flatnonzero((np.diff(at) > reach) | (doc[at][1:] != doc[at][:-1])) + 1
            rows = []
            for s, a in zip(np.split(seed, cut), np.split(at, cut), strict=True):
                d = doc[a[0]]
                low, high = max(before[d], a[0] - reach), min(before[d + 1], a[-1] + SPAN + reach)
                rows.append((d, low - before[d], words[low:high].view(np.int64), s.view(np.int64), a - low))
            yield pa.RecordBatch.from_arrays(
                [texts.ids("id").take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int64()),
                 *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (2, 3, 4))], ["id", "base", "words", "seeds", "places"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, base long, words array<long>, seeds array<long>, places array<long>")


def _verify(pairs: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """Compare along the diagonals of a stretch and an item."""

    def run(batches):
        for b in batches:
            got = {k: [] for k in ("id", "item", "doc_start", "item_start", "n_words", "n_equal")}
            for key, item, base, words, item_words, diagonals in zip(*(b.column(k).to_pylist() for k in ("id", "item", "base", "words", "item_words", "diagonals")), strict=True):
                words, other, best = np.array(words), np.array(item_words), None
                for d in set(diagonals):  # word i of the item stands at i + d of the stretch
                    low, high = max(0, -d), min(len(other), len(words) - d)
                    same = (words[low + d:high + d] == other[low:high]).astype(int)
                    span = min(SPAN, len(other))
                    if len(same) < span:
                        continue
                    need = ENOUGH if len(other) >= SPAN else span
                    sums = np.convolve(same, np.ones(span, int), "valid")
                    good = np.flatnonzero(sums >= need)
                    if not len(good):
                        continue
                    covered = np.zeros(len(same), bool)
                    for g in good:
                        covered[g:g + span] = True
                    found = (int((same * covered).sum()), int(covered.sum()), base + low + d + int(good[0]), low + int(good[0]))
                    best = max(best or found, found)
                if best:
                    for k, v in zip(got, (key, item, best[2], best[3], best[1], best[0]), strict=True):
                        got[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, b.column(k).type if k in ("id", "item") else pa.int64()) for k, v in got.items()})

    return pairs.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, doc_start long, item_start long, n_words long, n_equal long")


def overlaps(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, first word in each, words in overlapping windows, equal words) of every document and item that overlap."""
    spark = docs.sparkSession
    given = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    same = given.groupBy("text").agg(F.min("item").alias("first"))
    items = same.select(F.col("first").alias("item"), "text")
    lengths = items.select(F.size(F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")).alias("n"))
    reach = lengths.agg(F.max("n")).first()[0] or 0
    short = sorted(r[0] for r in lengths.where((F.col("n") > 0) & (F.col("n") < SPAN)).distinct().collect())  # at most SPAN - 1 values
    seeds = keep(benchmark_seeds(items, short, "item", "text"))
    words = _words_table(items, "item", "text")
    flags = bitmap(seeds, "seed", FILTER_BITS)
    stretches = keep(_stretches(docs, flags, short, max(reach, SPAN), id, text))
    number = stretches.withColumn("stretch", F.xxhash64("id", "base", "words"))
    hits = number.select("stretch", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("stretch", F.col("h.seeds").alias("seed"), F.col("h.places").alias("at"))
    met = hits.distinct().join(seeds, "seed").select("stretch", "item", (F.col("at") - F.col("place")).alias("d")).distinct()
    pairs = met.groupBy("stretch", "item").agg(F.collect_set("d").alias("diagonals"))  # at most words + item words values
    full = pairs.join(number.select("stretch", "id", "base", "words").distinct(), "stretch").join(words.hint("shuffle_hash"), "item")
    kinds = (docs.schema[id].dataType.simpleString(), benchmark.schema[item].dataType.simpleString())
    found = _verify(full.select("id", "item", "base", "words", "item_words", "diagonals"), kinds)
    best = found.groupBy("id", "item").agg(F.max(F.struct("n_equal", "n_words", "doc_start", "item_start")).alias("m"))
    named = best.join(given.join(same, "text").select(F.col("first").alias("item"), F.col("item").alias("_item")).distinct(), "item")
    return named.select(F.col("id").alias(id), F.col("_item").alias(item), "m.doc_start", "m.item_start", "m.n_words", "m.n_equal")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents without an overlap with any item; rows with a null id are compared by their text like all others."""
    name = fresh(docs, "_text_key")
    keyed = docs.withColumn(name, F.xxhash64(text))
    bad = overlaps(keyed.select(name, text), benchmark, name, text, item, item_text).select(name).distinct()
    return keyed.join(bad, name, "left_anti").select(*docs.columns)
