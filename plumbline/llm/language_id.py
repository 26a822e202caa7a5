"""Language identification by cross-parsing.

For every language a suffix automaton is built from labelled text. A document is parsed greedily against each automaton:
the longest match from the present place is one phrase. The phrases, each priced at the logarithm of the training length,
are divided by the document's length; the language that needs fewest wins, ties going to the smaller name.

The whole text is read, in blocks of `block` bytes from its beginning (a phrase ends at a block's end, for every language
alike), so that many blocks step through the automata together. Letters are lower-cased, other characters are one blank.
Nulls and texts without a letter are `und` with score 0. The labelled sample is bounded: `train_docs` documents per
language, chosen by hash among all eligible rows, and `train_bytes` bytes of them. Repeated rows are predicted one by one.
Without a labelled row everything is `und`. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.llm.kit import Texts, slices

TRAIN_DOCS = 400
TRAIN_BYTES = 96_000
BLOCK = 4096
UNKNOWN = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased letters of a text, all else one blank."""
    clean = _NO_LETTER.sub(" ", text.lower()).strip() if text else ""
    if clean and not clean.replace(" ", "").isalpha():  # \w also takes signs such as ½ and ², which are no letters
        clean = " ".join("".join(c if c.isalpha() else " " for c in clean).split())
    return clean


def training_text(docs: DataFrame, lang: str = "lang", text: str = "text", id: str = "doc_id",
                  train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(lang, h, text): at most `train_docs` different (id, text) pairs of each language, those with the smallest hashes.

    The counts and smallest hashes, one row per language like the model itself, go to all tasks; with them each task keeps about twice
    as many rows as are wanted, so only these few carry their text into the exchange that ranks them. Equal rows are one before
    that exchange, and the row of the smallest hash is always kept, so every language with a labelled text has a model."""
    held = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.xxhash64(F.col(id), F.col(text), F.lit(5)).alias("h"), F.col(text).alias("text"))
    counts = held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    small = F.col("h").cast("double") / 2.0**64 + 0.5 <= 2.0 * train_docs / F.col("n")
    few = held.join(F.broadcast(counts), "lang").where(small | (F.col("h") == F.col("least")))
    few = few.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= train_docs).select("lang", "h", "text")


class Automata:
    """Suffix automata of all languages as one table: next[state * width + symbol].

    A missing edge already leads to where the next phrase goes on from its language's start, marked by the top bit."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.sizes = np.array([max(2, len(texts[n].encode())) for n in self.names])
        seen = sorted({b for t in texts.values() for b in t.encode()})
        self.width = len(seen) + 1
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, self.width)
        tables, self.start, base = [], [], 0
        for name in self.names:
            edges = _suffix_automaton(self.symbol[np.frombuffer(texts[name].encode(), np.uint8)].tolist())
            table = np.full((len(edges), self.width), -1, np.int64)
            for s, out in enumerate(edges):
                for c, t in out.items():
                    table[s, c] = t + base
            root = table[0].copy()
            root[root < 0] = base  # a symbol never seen is a phrase of its own
            miss = table < 0
            table = np.where(miss, root[None, :] | (1 << 31), table)
            tables.append(table)
            self.start.append(base)
            base += len(edges)
        self.next = np.concatenate(tables).reshape(-1).astype(np.uint32) if tables else np.zeros(0, np.uint32)
        scaled = self.next & np.uint32(0x7FFFFFFF)
        self.next = (scaled * np.uint32(self.width)) | (self.next & np.uint32(1 << 31))  # states premultiplied by the width

    def phrases(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases that each block needs in each language: array (languages, blocks)."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        codes = self.symbol.astype(np.uint32)[data]
        k, n = len(self.names), len(start)
        state = np.repeat(np.array(self.start, np.uint32) * np.uint32(self.width), n).reshape(k, n)
        count = np.zeros((k, n), np.int32)
        live = np.searchsorted(-size, -np.arange(1, (size[0] if n else 0) + 1), "right")  # blocks longer than each step
        low, top = np.uint32(0x7FFFFFFF), np.uint32(31)
        for step, m in enumerate(live):
            c = codes[start[:m] + step]
            for j in range(k):
                got = self.next[state[j, :m] + c]
                count[j, :m] += (got >> top).astype(np.int32)
                state[j, :m] = got & low
        out = np.empty((k, n), np.int64)
        out[:, order] = count + 1
        return out


def _suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Edges of the smallest automaton of all substrings (Blumer et al.), grown symbol by symbol."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        now, p = len(edges) - 1, last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                twin = len(edges) - 1
                link[q] = link[now] = twin
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
        last = now
    return edges


_built: dict[str, Automata] = {}


def automata(texts: dict[str, str]) -> Automata:
    """Built once in each Python worker."""
    name = hashlib.sha256(repr(sorted(texts.items())).encode()).hexdigest()
    if name not in _built:
        _built.clear()
        _built[name] = Automata(texts)
    return _built[name]


def sample(docs: DataFrame, lang: str = "lang", text: str = "text", id: str = "doc_id", train_docs: int = TRAIN_DOCS,
           train_bytes: int = TRAIN_BYTES) -> dict[str, str]:
    """Training text of each language: at most train_bytes bytes, cut in Spark before it reaches the driver. Of each training
    text a slice of 8 * train_bytes / train_docs characters at a place given by its hash is read; texts to be judged are
    always read whole."""
    chosen = training_text(docs, lang, text, id, train_docs)
    share = max(1, -(-train_bytes // train_docs)) * 8
    place = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - share + 1)).cast("int") + 1
    parts: dict[str, list[str]] = {}
    for row in chosen.select("lang", "h", F.substring("text", place, F.lit(share)).alias("t")).orderBy("lang", "h", "t").toLocalIterator():
        parts.setdefault(row.lang, []).append(letters(row.t))
    return {name: _cut(" ".join(x), train_bytes) for name, x in parts.items()}


def _cut(text: str, size: int) -> str:
    return text.encode()[:size].decode("utf-8", "ignore")


def identify(docs: DataFrame, labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
             train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, block: int = BLOCK) -> DataFrame:
    """(id, lang_pred, score, phrases per 1,000 bytes) of every row of docs; score is the winner's share of exp(-cost)."""
    model = docs.sparkSession.sparkContext.broadcast(sample(labelled, lang, text, id, train_docs, train_bytes))

    def run(batches):
        m = automata(model.value)
        price = np.log(m.sizes.astype(float)) if m.names else np.zeros(0)
        for given in slices(batches):
            clean = [letters(t) for t in given.batch.column("text").to_pylist()]
            plain = Texts(pa.RecordBatch.from_pydict({"text": pa.array(clean, pa.string())}))
            size = np.diff(plain.at)
            blocks = -(-size // block)
            doc = np.repeat(np.arange(len(clean)), blocks)
            within = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            start = plain.at[:-1][doc] + within * block
            pred, score, rate = [UNKNOWN] * len(clean), np.zeros(len(clean)), np.zeros(len(clean))
            if m.names and len(doc):
                counts = m.phrases(plain.data, start, np.minimum(block, plain.at[1:][doc] - start))
                total = np.stack([np.bincount(doc, row, len(clean)) for row in counts])
                cost = total * price[:, None]
                best = np.argmin(cost, 0)
                some = size > 0
                share = np.exp(np.maximum(cost[best, np.arange(len(clean))] - cost, -700))
                score = np.where(some, 1 / share.sum(0), 0.0)
                rate = np.where(some, 1000 * total[best, np.arange(len(clean))] / np.maximum(size, 1), 0.0)
                pred = [m.names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
            yield pa.RecordBatch.from_arrays([given.ids("id"), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)],
                                             ["id", "lang_pred", "score", "phrase_rate"])

    kind = docs.schema[id].dataType.simpleString()
    found = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double, phrase_rate double")
    return found.withColumnRenamed("id", id)
