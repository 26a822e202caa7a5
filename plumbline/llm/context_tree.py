"""Context-tree weighting over bytes, each byte coded as eight binary decisions.

Every decision (the bits of the byte known so far) has its own context tree over the last DEPTH bytes. A node's estimate is
Krichevsky-Trofimov's for the bits counted there; its weighted probability is half of it and half of the product over its
children. With the counts frozen after training, the probability of a bit is the mixture over all depths of its context's
path, weighted by what each node's own estimate explains of its data; a context not seen in training ends the path (an
unseen child gives 1/2). Summed over a text's bytes and its end mark this is the code length.

Nothing of the model's size goes to the driver or to all tasks. A block (one partition of the input) sends its distinct
contexts-with-byte to the part of the model that their two latest bytes select; counts of all blocks meet there, the trees
from depth two down are weighted there, and only the sums over depths one and none (at most 65,536 nodes) pass through the
driver. Each block gets the values for its own contexts back, and its documents are scored with them. Words, for the
unigram base, take the same way. Within a part keys are exact; words are compared by 64-bit hashes.

A-Z are lower-cased. Null texts are empty: one end token, one end mark. Without training rows every bit has probability
1/2. Repeated rows count as often as they occur. The input is read twice and must be dealt the same way each time, as a table
scan is; a block whose contexts differ the second time fails loudly. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kit import LOWER, Texts, U, keep, mix, shuffle_parts, slices

DEPTH = 5
END = 255  # not a byte of UTF-8; also fills the context before a text
LOG2, LOG10 = np.log(2.0), np.log(10.0)


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with its context as one key, the latest context byte highest, and each document's first position."""
    n, k = len(texts), DEPTH + 1
    length = np.diff(texts.at)
    at = np.concatenate([[0], np.cumsum(length + 1)])
    padded = np.full(int(at[-1]) + n * DEPTH, END, np.uint8)
    where = np.arange(len(texts.data)) + np.repeat(np.arange(n) * k + DEPTH, length)
    padded[where] = LOWER[texts.data]
    scored = np.arange(int(at[-1])) + np.repeat((np.arange(n) + 1) * DEPTH, length + 1)
    key = padded[scored].astype(U)
    for j in range(1, k):
        key |= padded[scored - j].astype(U) << U(8 * (k - j))
    return key, at


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(counts, at)


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.diff(np.append(at, len(keys)))


def _part(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    spread = mix(keys >> U(8 * DEPTH - 8)) if kind == 0 else keys
    return (((spread >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def _slice_keys(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of kind 0 (contexts) and 1 (words) with each document's first position."""
    start, end, before = texts.words()
    return [grams(texts), (texts.hashes(start, end), before)]


class _Held:
    """Distinct keys with training counts, merged as they come."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.size = np.zeros(0, U), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > 4 * len(self.keys) + 1_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            keys, counts = zip((self.keys, self.counts), *self.waiting, strict=True)
            self.keys, self.counts = _counted(np.concatenate(keys), np.concatenate(counts))
            self.waiting, self.size = [], 0
        return self.keys, self.counts


def _ask(docs: DataFrame, parts: int) -> DataFrame:
    """(kind, p, block, keys, counts): distinct keys of each block with their counts in its training rows."""

    def run(batches):
        held, block = (_Held(), _Held()), None
        for texts in slices(batches):
            block = texts.ids("block")[0].as_py()
            train = np.asarray(texts.ids("train"))
            for kind, (keys, at) in enumerate(_slice_keys(texts)):
                doc = np.repeat(train, np.diff(at))
                held[kind].add(*_tally(keys[doc]))
                other, n = _tally(keys[~doc])
                held[kind].add(other, np.zeros(len(n), np.int64))
        for kind, h in enumerate(held):
            keys, counts = h.merge()
            p = _part(keys, kind, parts)
            order = np.argsort(p, kind="stable")
            cut = np.searchsorted(p[order], np.arange(parts + 1))
            for i in range(parts):
                if cut[i] < cut[i + 1]:
                    some = order[cut[i]:cut[i + 1]]
                    yield pa.RecordBatch.from_pydict({"kind": [kind], "p": [i], "block": [block], "keys": pa.array([keys[some].tobytes()], pa.binary()),
                                                      "counts": pa.array([counts[some].tobytes()], pa.binary())})

    return docs.mapInArrow(run, "kind long, p long, block long, keys binary, counts binary")


def _gather(asked: DataFrame) -> DataFrame:
    """One row for each part: all its keys with their counts, and for each block the places of its keys among them."""

    def merged(kind: int, p: int, rows: list) -> pa.RecordBatch:
        keys, counts = _counted(np.concatenate([np.frombuffer(k, U) for _, k, _ in rows]), np.concatenate([np.frombuffer(c, np.int64) for *_, c in rows]))
        places = [np.searchsorted(keys, np.frombuffer(k, U)).astype(np.uint32).tobytes() for _, k, _ in rows]
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays(
            [one(kind, pa.int64()), one(p, pa.int64()), one(int((counts > 0).sum()), pa.int64()), one(int(counts.sum()), pa.int64()), one(keys.tobytes(), pa.binary()),
             one(counts.tobytes(), pa.binary()), one([b for b, *_ in rows], pa.list_(pa.int64())), one(places, pa.list_(pa.binary()))],
            ["kind", "p", "n_seen", "n_total", "keys", "counts", "blocks", "places"])

    def run(batches):
        now, rows = None, []
        for b in batches:
            for kind, p, block, keys, counts in zip(*(b.column(c).to_pylist() for c in ("kind", "p", "block", "keys", "counts")), strict=True):
                if now != (kind, p):
                    if rows:
                        yield merged(*now, rows)
                    now, rows = (kind, p), []
                rows.append((block, keys, counts))
        if rows:
            yield merged(*now, rows)

    return asked.mapInArrow(run, "kind long, p long, n_seen long, n_total long, keys binary, counts binary, blocks array<long>, places array<binary>")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Tree:
    """Nodes of depths 2 to DEPTH of one part. A node's key: its context bytes, then the bits known so far behind a leading 1."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        seen = counts > 0
        keys, counts = keys[seen], counts[seen].astype(float)
        byte = keys & U(255)
        self.nodes, self.n0, self.n1 = {}, {}, {}
        for d in range(2, DEPTH + 1):
            context = keys >> U(8 + 8 * (DEPTH - d))
            k, n = _counted(context << U(8) | byte, counts)
            b = k & U(255)
            node, bit = [], []
            for j in range(8):
                node.append((k >> U(8)) << U(8) | U(1 << j) | (b >> U(8 - j)))
                bit.append((b >> U(7 - j)) & U(1))
            node, bit, n = np.concatenate(node), np.concatenate(bit), np.tile(n, 8)
            self.nodes[d], total = _counted(node, n)
            _, self.n1[d] = _counted(node, n * bit)
            self.n0[d] = total - self.n1[d]
        self.log_own = {d: _estimate(self.n0[d], self.n1[d]) for d in self.nodes}
        self.log_all = {DEPTH: self.log_own[DEPTH]}
        self.up = {d: np.searchsorted(self.nodes[d - 1], self.parent(d)) for d in range(3, DEPTH + 1)}
        for d in range(DEPTH - 1, 1, -1):
            below = np.bincount(self.up[d + 1], self.log_all[d + 1], len(self.nodes[d]))
            self.log_all[d] = np.logaddexp(self.log_own[d], below) - LOG2

    def parent(self, d: int) -> np.ndarray:
        return (self.nodes[d] >> U(16)) << U(8) | (self.nodes[d] & U(255))

    def predict(self, keys: np.ndarray, top: "Top") -> np.ndarray:
        """log10 of the byte's probability for every key, each bit at its deepest node seen in training."""
        above = self.parent(2).astype(np.int64)
        mass, rest, one = {1: top.mass.reshape(-1)[above]}, {1: top.rest.reshape(-1)[above]}, {}
        for d in range(2, DEPTH + 1):
            up = slice(None) if d == 2 else self.up[d]
            own = np.exp(self.log_own[d] - LOG2 - self.log_all[d]) if d < DEPTH else 1.0
            bit = (self.n1[d] + 0.5) / (self.n0[d] + self.n1[d] + 1.0)
            mass[d] = mass[d - 1][up] + rest[d - 1][up] * own * bit
            rest[d] = rest[d - 1][up] * (1 - own)
            one[d] = mass[d] + rest[d] / 2
        total = np.zeros(len(keys))
        byte = keys & U(255)
        for j in range(8):
            bits = U(1 << j) | (byte >> U(8 - j))
            p = top.one[(keys >> U(8 * DEPTH)).astype(np.int64), bits.astype(np.int64)]
            todo = np.arange(len(keys))
            for d in range(DEPTH, 1, -1):  # deepest first; most end there
                node = (keys[todo] >> U(8 + 8 * (DEPTH - d))) << U(8) | bits[todo]
                at = np.minimum(np.searchsorted(self.nodes[d], node), max(0, len(self.nodes[d]) - 1))
                found = self.nodes[d][at] == node if len(self.nodes[d]) else np.zeros(len(todo), bool)
                p[todo[found]] = one[d][at[found]]
                todo = todo[~found]
                if not len(todo):
                    break
            bit = (byte >> U(7 - j)) & U(1)
            total += np.log(np.where(bit == 1, p, 1 - p))
        return total / LOG10


class Top:
    """Depths one and none, from sums over the parts: arrays (latest byte, node)."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        own1 = _estimate(n0, n1)
        all1 = np.logaddexp(own1, below) - LOG2
        m0, m1 = n0.sum(0), n1.sum(0)
        own0 = _estimate(m0, m1)
        w0 = np.exp(own0 - LOG2 - (np.logaddexp(own0, all1.sum(0)) - LOG2))
        w1 = np.exp(own1 - LOG2 - all1)
        root = w0 * (m1 + 0.5) / (m0 + m1 + 1.0)
        self.mass = root + (1 - w0) * w1 * (n1 + 0.5) / (n0 + n1 + 1.0)
        self.rest = (1 - w0) * (1 - w1)
        self.one = np.where(n0 + n1 > 0, self.mass + self.rest / 2, root + (1 - w0) / 2)


def _top(model: DataFrame) -> Top:
    def run(batches):
        n0, n1, below = (np.zeros(65536) for _ in range(3))
        for b in batches:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree = Tree(np.frombuffer(keys, U), np.frombuffer(counts, np.int64))
                up = tree.parent(2).astype(np.int64)
                for total, add in ((n0, tree.n0[2]), (n1, tree.n1[2]), (below, tree.log_all[2])):
                    total += np.bincount(up, add, 65536)
        some = np.flatnonzero(n0 + n1)
        yield pa.RecordBatch.from_pydict({"node": some, "n0": n0[some], "n1": n1[some], "below": below[some]})

    sums = (model.where("kind = 0").select("keys", "counts").mapInArrow(run, "node long, n0 double, n1 double, below double")
            .groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).collect())
    out = np.zeros((3, 65536))
    for node, *values in sums:
        out[:, node] = values
    return Top(*(x.reshape(256, 256) for x in out))


def _answers(model: DataFrame, top: Top) -> DataFrame:
    """(block, kind, p, values): what each block asked for, float32 log10 probabilities of contexts or int64 counts of words."""
    held = model.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        for b in batches:
            for kind, p, keys, counts, blocks, places in zip(*(b.column(c).to_pylist() for c in ("kind", "p", "keys", "counts", "blocks", "places")), strict=True):
                keys, values = np.frombuffer(keys, U), np.frombuffer(counts, np.int64)
                if kind == 0:
                    values = Tree(keys, values).predict(keys, held.value).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"block": blocks, "kind": [kind] * len(blocks), "p": [p] * len(blocks),
                                                  "answer": pa.array([values[np.frombuffer(x, np.uint32)].tobytes() for x in places], pa.binary())})

    return model.select("kind", "p", "keys", "counts", "blocks", "places").mapInArrow(run, "block long, kind long, p long, answer binary")


class _Lookup:
    """Values by 64-bit key: keys in scrambled order with a directory over their top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix(keys)
        order = np.argsort(h, kind="stable")
        self.h, self.values = h[order], values[order]
        self.bits = max(8, int(len(h)).bit_length() + 1)
        self.first = np.searchsorted(self.h, np.arange(1 << self.bits, dtype=U) << U(64 - self.bits)).astype(np.int64)
        self.h = np.append(self.h, U(0))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys)
        at = self.first[(h >> U(64 - self.bits)).astype(np.int64)]
        todo = np.flatnonzero(self.h[at] != h)
        while len(todo):
            at[todo] += 1
            if at[todo].max() >= len(self.h):
                raise ValueError("a block's documents changed between two reads of the input")
            todo = todo[self.h[at[todo]] != h[todo]]
        return self.values[at]


def score(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row; `train` marks the rows to learn from."""
    spark = docs.sparkSession
    parts = 2 * shuffle_parts(spark)
    rows = docs.select(F.spark_partition_id().cast("long").alias("block"), F.col(id).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    asked = _ask(rows, parts).repartition(shuffle_parts(spark), "kind", "p").sortWithinPartitions("kind", "p")
    model = keep(_gather(asked))
    ends = docs.where(train).count()
    distinct, total = model.where("kind = 1").agg(F.sum("n_seen"), F.sum("n_total")).first()
    n, v = (total or 0) + ends, (distinct or 0) + (ends > 0)
    answers = _answers(model, _top(model))
    kind_of = docs.schema[id].dataType
    blank = lambda t: F.lit(None).cast(t)
    told = answers.select("block", F.lit(0).alias("stage"), "kind", "p", "answer", blank(kind_of).alias("id"), blank("string").alias("text"))
    texts = rows.select("block", F.lit(1).alias("stage"), blank("long").alias("kind"), blank("long").alias("p"), blank("binary").alias("answer"), "id", "text")
    together = told.unionByName(texts).repartition(F.col("block")).sortWithinPartitions("block", "stage", "kind", "p")
    base = np.log10(n + 0.5 * (v + 1))

    def block_rows(answers: dict, batches: list) -> pa.RecordBatch:
        held, value = (_Held(), _Held()), []
        for texts in batches:
            for kind, (keys, _) in enumerate(_slice_keys(texts)):
                held[kind].add(*_tally(keys))
        for kind, h in enumerate(held):
            keys, _ = h.merge()
            p = _part(keys, kind, parts)
            values = np.zeros(len(keys), np.float32 if kind == 0 else np.int64)
            order = np.argsort(p, kind="stable")
            cut = np.searchsorted(p[order], np.arange(parts + 1))
            for i in np.flatnonzero(np.diff(cut)):
                got = answers.get((kind, int(i)), b"")
                if len(got) != (cut[i + 1] - cut[i]) * values.itemsize:
                    raise ValueError("a block's documents changed between two reads of the input")
                values[order[cut[i]:cut[i + 1]]] = np.frombuffer(got, values.dtype)
            value.append(_Lookup(keys, values))
        for texts in batches:
            (keys, at), (words, before) = _slice_keys(texts)
            sums = np.concatenate([[0.0], np.cumsum(value[0](keys).astype(float))])
            model_score = sums[at[1:]] - sums[at[:-1]]
            c = value[1](words)
            logs, known = np.concatenate([[0.0], np.cumsum(np.log10(c + 0.5))]), np.concatenate([[0], np.cumsum(c > 0)])
            tokens = np.diff(before) + 1
            base_score = logs[before[1:]] - logs[before[:-1]] + np.log10(ends + 0.5) - tokens * base
            length = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [texts.ids("id"), pa.array(tokens), pa.array(known[before[1:]] - known[before[:-1]] + int(ends > 0)), pa.array(np.full(len(texts), n, np.int64)),
                 pa.array(base_score), pa.array(model_score), pa.array(-model_score * LOG10 / LOG2 / length)],
                ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    def run(batches):
        now, answers, waiting = None, {}, []
        for b in batches:
            blocks = b.column("block").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for i, j in zip(cut, cut[1:]):
                if i == j:
                    continue
                if blocks[i] != now:
                    if waiting:
                        yield from block_rows(answers, waiting)
                    now, answers, waiting = blocks[i], {}, []
                some = b.slice(i, j - i)
                stage = some.column("stage").to_numpy()
                split = int(np.searchsorted(stage, 1))
                for kind, p, answer in zip(*(some.slice(0, split).column(c).to_pylist() for c in ("kind", "p", "answer")), strict=True):
                    answers[kind, p] = answer
                waiting += list(slices([some.slice(split)]))
        if waiting:
            yield from block_rows(answers, waiting)

    out = together.mapInArrow(run, f"id {kind_of.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    return out.withColumnRenamed("id", id)
