"""Best-fit packing of whole token lists into as few sequences as possible, by linear grouping.

Documents become pieces of at most `tokens` ids; only longer ones are cut. Pieces are written once, numbered inside their
task and length. What the packing depends on is the number of pieces of each length, at most `tokens` values whatever the
number of documents, so the plan is made on the driver from that histogram:
  - large lengths, in descending order, form groups of equal cardinality and are rounded up to the largest of their group;
  - the few sizes are packed by a linear program over configurations (multisets of sizes that fit), whose columns come from
    a knapsack; the whole part of its solution is kept;
  - actual documents take the places of the rounded sizes, which leaves some room in each sequence;
  - the documents left over by the rounding of the program, and the small ones, go largest first into the sequence with
    the least sufficient room, or open new ones.
Sequences of equal content stand next to each other, so the plan is a list of runs (length, ranks, sequences, offset) of a few
thousand rows. Every piece finds its rank among the pieces of its length by adding the counts of earlier tasks, and its place
by a search in the runs. No task ever holds a group of documents.

Null and empty texts consist of the end id alone; repeated rows are packed once each; null ids are passed on; ties (equal
lengths) are placed in the order of tasks and rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.llm.kit import keep, slices
from plumbline.llm.packing import word_ids

TOKENS, END_ID, GROUPS = 2048, 0, 64
#: Lengths up to this share of a sequence are small.
SMALL = 1 / 8
CUT = "piece int, start long, length int, ids_crc32 long, part int, nth long"


class Run(NamedTuple):
    """Pieces of one length with ranks first to first + count - 1: `per` of them side by side in each sequence from `sequence` on."""

    length: int
    first: int
    count: int
    per: int
    sequence: int
    offset: int


def cut_pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", tokens: int = TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The id and CUT for every piece: `part` and `nth` number the pieces of equal length inside a task. with_ids: also the ids."""
    def run(batches):
        words, part, seen = word_ids(tokenizer), TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64)
        for texts in slices(batches):
            ids, at = words.of(texts)
            ids[at[1:] - 1] = end_id
            count = -(-np.diff(at) // tokens)
            doc = np.repeat(np.arange(len(texts)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * tokens
            length = np.minimum(tokens, np.diff(at)[doc] - start)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=tokens + 1)
            parts = [ids[a:a + n] for a, n in zip(at[doc] + start, length, strict=True)]
            out = {"id": texts.ids("id").take(pa.array(doc)), "piece": piece.astype(np.int32), "start": start, "length": length.astype(np.int32),
                   "ids_crc32": np.array([zlib.crc32(p.tobytes()) for p in parts], np.int64), "part": np.full(len(doc), part, np.int32), "nth": nth}
            if with_ids:
                out["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id].dataType.simpleString()
    held = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return held.mapInArrow(run, f"id {kind}, {CUT}" + (", ids array<int>" if with_ids else ""))


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> np.ndarray:
    """How many of each size to take for the greatest value; level by level of the number of pieces taken."""
    shift = np.arange(room + 1)[None, :] - sizes[:, None]
    allowed = shift >= 0
    shift = np.where(allowed, shift, 0)
    best, choices = np.zeros(room + 1), []
    while True:
        worth = np.where(allowed, best[shift] + values[:, None], -1.0)
        choice = worth.argmax(0)
        gain = worth[choice, np.arange(room + 1)]
        better = gain > best + 1e-12
        if not better[room] and not better.any() or len(choices) * sizes.min() > room:
            break
        choices.append(np.where(better, choice, -1))
        best = np.maximum(best, gain)
    taken = np.zeros(len(sizes), np.int64)
    at = room
    for level in reversed(choices):
        if level[at] >= 0:
            taken[level[at]] += 1
            at -= sizes[level[at]]
    return taken


def configurations(sizes: np.ndarray, wanted: np.ndarray, room: int, steps: int = 3000) -> list[tuple[int, np.ndarray]]:
    """(how often, how many of each size) that together hold at most the wanted numbers: the whole part of the linear program."""
    if not len(sizes):
        return []
    columns = np.diag(room // sizes).astype(float)
    inverse = np.linalg.inv(columns)
    amount = inverse @ wanted
    for step in range(steps):  # any step leaves a right packing, so a bound on their number is safe
        price = inverse.sum(0)
        taken = knapsack(sizes, price, room)
        if taken @ price <= 1 + 1e-9:
            break
        change = inverse @ taken
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        leaving = int(ratio.argmin())
        columns[:, leaving] = taken
        if step % 50 == 49:
            inverse = np.linalg.inv(columns)
            amount = np.maximum(inverse @ wanted, 0)
        else:
            amount = np.maximum(amount - ratio[leaving] * change, 0)
            amount[leaving] = ratio[leaving]
            inverse[leaving] /= change[leaving]
            others = np.arange(len(sizes)) != leaving
            inverse[others] -= change[others, None] * inverse[leaving]
    left, found = wanted.astype(np.int64).copy(), []
    for amounts, column in zip(amount, columns.T.astype(np.int64), strict=True):
        used = column > 0
        times = min(int(amounts + 1e-6), int((left[used] // column[used]).min()))
        if times > 0:
            found.append((times, column))
            left -= times * column
    return found


class Plan:
    """Runs of pieces in sequences, from the number of pieces of each length."""

    def __init__(self, counts: np.ndarray, tokens: int = TOKENS, groups: int = GROUPS, small: float = SMALL):
        self.tokens = tokens
        self.counts = counts
        self.used = np.zeros(tokens + 1, np.int64)  # ranks given out, by length
        self.runs: list[Run] = []
        self.sequences = 0
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(tokens + 1)]  # by tokens left: (first sequence, sequences)
        self._whole()
        self._large(groups, int(tokens * small))
        self._best_fit()

    def put(self, length: int, count: int, per: int, sequence: int, offset: int) -> None:
        self.runs.append(Run(length, int(self.used[length]), count, per, sequence, offset))
        self.used[length] += count

    def _whole(self) -> None:
        n = int(self.counts[self.tokens])
        if n:
            self.put(self.tokens, n, 1, 0, 0)
            self.sequences = n

    def _large(self, groups: int, small: int) -> None:
        lengths = np.arange(self.tokens - 1, small, -1)
        counts = self.counts[lengths]
        lengths, counts = lengths[counts > 0], counts[counts > 0]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return
        each = -(-total // groups)
        wanted = np.diff([*range(0, total, each), total])
        starts = np.cumsum(wanted) - wanted
        sizes = lengths[np.searchsorted(ends, starts, "right")]  # the largest of each group
        waiting = starts.copy()  # next piece of each group, in descending order of all large pieces
        given: list[list[int]] = []  # [length, first place in the descending order, sequence, sequences, offset]
        for times, column in configurations(sizes, wanted, self.tokens):
            slots = [g for g in np.flatnonzero(column) for _ in range(column[g])]
            firsts = []
            for g in slots:
                firsts.append(int(waiting[g]))
                waiting[g] += times
            edges = {0, times}
            for first in firsts:
                inner = ends[(ends > first) & (ends < first + times)] - first
                edges |= set(inner.tolist())
            edges = sorted(edges)
            for a, b in zip(edges, edges[1:]):
                offset = 0
                for first in firsts:
                    length = int(lengths[np.searchsorted(ends, first + a, "right")])
                    given.append([length, first + a, self.sequences + a, b - a, offset])
                    offset += length
                self.room[self.tokens - offset].append((self.sequences + a, b - a))
            self.sequences += times
        for length, _, sequence, n, offset in sorted(given):
            self.put(length, n, 1, sequence, offset)

    def _best_fit(self) -> None:
        for length in range(self.tokens - 1, 0, -1):
            left = int(self.counts[length] - self.used[length])
            space = length
            while left:
                while space <= self.tokens and not self.room[space]:
                    space += 1
                if space > self.tokens:
                    opened = -(-left // (self.tokens // length))
                    self.room[self.tokens].append((self.sequences, opened))
                    self.sequences += opened
                    space = self.tokens
                sequence, n = self.room[space].pop()
                per = space // length
                full = min(n, left // per)
                if full:
                    self.put(length, full * per, per, sequence, self.tokens - space)
                    self.room[space - per * length].append((sequence, full))
                    left, sequence, n = left - full * per, sequence + full, n - full
                if n and left and left < per:
                    self.put(length, left, left, sequence, self.tokens - space)
                    self.room[space - left * length].append((sequence, 1))
                    left, sequence, n = 0, sequence + 1, n - 1
                if n:
                    self.room[space].append((sequence, n))


#: Ranks below 2^40 beside the length in one search key.
RANK_BITS = 40


def placed(pieces: DataFrame, runs: list[Run]) -> DataFrame:
    """Pieces (with `length` and `rank`) with `sequence_id` and `offset`. The runs are a few thousand, whatever the number of pieces."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    keys = (table[:, 0] << RANK_BITS) + table[:, 1]

    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << RANK_BITS) + rank, "right") - 1
            k, per = rank - table[at, 1], table[at, 3]
            columns = [b.column(c) for c in names] + [pa.array(table[at, 4] + k // per), pa.array(table[at, 5] + k % per * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    names = [c for c in pieces.columns if c != "rank"]
    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names)
    return pieces.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", tokens: int = TOKENS, end_id: int = END_ID, groups: int = GROUPS,
         small: float = SMALL, with_ids: bool = True) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the token ids themselves."""
    pieces = keep(cut_pieces(docs, tokenizer, id, text, tokens, end_id, with_ids))
    by_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(tokens + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    plan = Plan(counts, tokens, groups, small)
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("earlier"))
    columns = ["id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    return placed(ranked.select(*columns, "rank"), plan.runs).withColumn("length", F.col("length").cast("long")).withColumnRenamed("id", id)
