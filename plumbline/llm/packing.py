"""Vector bin packing of token pieces into training sequences.

Every task packs the documents of its partition. A sequence has three limits at once: tokens, pieces (segments) and
loss-bearing tokens. Whole sequences are cut off long documents; the rests wait in a pool of fixed size, and an open
sequence takes the waiting piece with the largest dot product of its demand with the room that is left (each as a share of
its limit). When no whole piece fits, one is cut to fill the gap. A sequence that another limit closes before its tokens are
full, and the last one of a partition, is cut at powers of two, which need no padding. Memory is bounded by the pool, one slice of text and a word memo of fixed size.

Tokens come from a public tokenizer file; it drops white space, so each word is encoded once and looked up afterwards.
Null and empty texts consist of the end token alone. Repeated rows are packed once each. Null ids are passed on. Other
columns are not read. Sequence ids are partition number * 2^33 + count, so a task that runs again repeats its ids.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kit import LOWER, Texts, U, slices

END_ID = 1
POOL = 128
MEMO_WORDS = 1_500_000
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids of words by hash, in flat arrays; forgets all when full, so its memory is bounded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(model.values()) + 1, bool)
        self.ends[[i for token, i in model.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.counts, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Words that are runs of letters are encoded many at a time and split at the word-end tokens; others singly."""
        lists: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        for at in range(0, len(plain), 256):
            some = plain[at: at + 256]
            ids = np.array(self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some) and cut[-1] == len(ids):
                for i, part in zip(some, np.split(ids, cut[:-1]), strict=True):
                    lists[i] = part
        rest = [i for i, x in enumerate(lists) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            lists[i] = np.array(e.ids, np.uint32)
        counts = np.array([len(x) for x in lists], np.int64)
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, *lists])
        hashes, starts, counts = (np.concatenate(x) for x in ((self.hashes, hashes), (self.starts, starts), (self.counts, counts)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.counts = hashes[order], starts[order], counts[order]

    def of(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's documents, each with the end id, and the first index of every document (n + 1 values)."""
        first, last, doc = pieces(texts)
        found = texts.hashes(first, last)
        distinct, where, inverse = np.unique(found, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > MEMO_WORDS:
            self.clear()
        new = ~_has(self.hashes, distinct)
        if new.any():
            low = LOWER[texts.data].tobytes()
            self.learn(distinct[new], [low[first[i]:last[i]].decode("utf-8") for i in where[new]])
        at = np.searchsorted(self.hashes, distinct)
        counts = self.counts[at][inverse]
        starts = self.starts[at][inverse]
        before = np.concatenate([[0], np.cumsum(counts)])
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))  # pieces before each document
        spread = np.repeat(starts - before[:-1], counts) + np.arange(before[-1])
        marks = before[edge[1:]]  # where each document's end id goes
        return np.insert(self.ids[spread], marks, END_ID), before[edge] + np.arange(len(texts) + 1)


def _has(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(asked), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)] == asked


#: Kinds of bytes for cutting words where the tokenizer always cuts: between an ASCII letter and an ASCII sign or digit.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[128:] = 0
_WHOLE = re.compile(rb"['<]")


def pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges that the tokenizer treats apart, and the document of each.

    Words with an apostrophe (contractions) or `<` (special tokens) stay whole."""
    start, end, before = texts.words()
    doc = np.repeat(np.arange(len(texts)), np.diff(before))
    if not len(start):
        return start, end, doc
    kind = _KIND[texts.data]
    whole = (texts.data == 39) | (texts.data == 60)
    marks = np.concatenate([[0], np.cumsum(whole)])
    free = marks[end] == marks[start]
    cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    word = np.searchsorted(start, cut, "right") - 1
    inside = (word >= 0) & (cut > start[word]) & (cut < end[word])
    cut, word = cut[inside], word[inside]
    cut, word = cut[free[word]], word[free[word]]
    first = np.sort(np.concatenate([start, cut]))
    last = np.sort(np.concatenate([end, cut]))
    return first, last, np.repeat(doc, 1 + np.bincount(word, minlength=len(start)))


class Packer:
    """Packs pieces (document, start, length, loss-bearing tokens) into sequences, one open sequence at a time."""

    def __init__(self, tokens: int, segments: int, loss: int, first_id: int):
        self.limit = np.array([tokens, segments, loss], float)
        self.next_id = first_id
        self.docs: list = []
        self.demand = np.zeros((0, 3))
        self.rows: list[tuple] = []

    def add(self, doc, length: int, prompt: int) -> None:
        """A whole document; its first `prompt` tokens bear no loss. doc(start, length) describes a piece of it."""
        start = 0
        tokens, _, loss = (int(x) for x in self.limit)
        while length - start > 0:
            room = min(tokens, length - start)
            free = max(0, min(prompt - start, room))
            room = min(room, free + loss)
            if room == tokens:
                self.rows.append((doc, start, room, self.next_id, 0))
                self.next_id += 1
            else:
                self.docs.append((doc, start, prompt))
                self.demand = np.vstack([self.demand, [room, 1, room - min(free, room)]])
                if len(self.docs) >= POOL:
                    self.fill()
            start += room

    def fill(self, last: bool = False) -> None:
        """Fill one sequence from the pool by the dot-product rule, and cut a piece into the gap that is left."""
        room, taken = self.limit.copy(), []
        while len(self.docs) and room[0] > 0 and room[1] > 0:
            fits = (self.demand <= room).all(1)
            if fits.any():
                score = (self.demand / self.limit) @ (room / self.limit)
                i = int(np.argmax(np.where(fits, score, -1)))
                size = int(self.demand[i, 0])
            else:
                i = int(np.argmax(self.demand[:, 0]))
                _, start, prompt = self.docs[i]
                free = max(0, prompt - start)
                size = int(min(room[0], self.demand[i, 0], free + room[2]))
                if size <= 0:
                    break
            doc, start, prompt = self.docs[i]
            borne = size - min(size, max(0, prompt - start))
            taken.append((doc, start, size))
            room -= [size, 1, borne]
            if size == int(self.demand[i, 0]):
                self.docs.pop(i)
                self.demand = np.delete(self.demand, i, 0)
            else:
                self.docs[i] = (doc, start + size, prompt)
                self.demand[i] -= [size, 0, borne]
        self.emit(taken, last or room[0] > 0)

    def emit(self, taken: list, last: bool) -> None:
        used = sum(size for *_, size in taken)
        offset, left = 0, used if not last or used == int(self.limit[0]) else 1 << used.bit_length() - 1
        for doc, start, size in taken:
            while size:
                now = min(size, left)
                self.rows.append((doc, start, now, self.next_id, offset))
                start, size, offset, left, used = start + now, size - now, offset + now, left - now, used - now
                if not left and used:
                    self.next_id += 1
                    offset, left = 0, 1 << used.bit_length() - 1
        self.next_id += 1

    def end(self) -> None:
        while self.docs:
            self.fill(last=self.demand[:, 0].sum() <= self.limit[0])


_held: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of this Python worker."""
    if path not in _held:
        _held.clear()
        _held[path] = WordIds(path)
    return _held[path]


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", prompt: str | None = None, tokens: int = 2048,
         segments: int = 64, loss: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: the id, SCHEMA, and with_ids the token ids themselves.

    `prompt` names a column with the number of leading tokens that bear no loss (null: none); without it only the first
    token of a document bears none.
    """
    def run(batches):
        words = word_ids(tokenizer)
        packer = Packer(tokens, segments, loss, TaskContext.get().partitionId() << 33)

        def rows():
            made, packer.rows = packer.rows, []
            out = {id: pa.array([d[0] for d, *_ in made], id_type)}
            out["start"], out["length"] = [s for _, s, *_ in made], [n for _, _, n, *_ in made]
            parts = [d[1][s:s + n] for d, s, n, *_ in made]
            out["ids_crc32"] = [zlib.crc32(p.tobytes()) for p in parts]
            out["doc_tokens"] = [len(d[1]) for d, *_ in made]
            out["sequence_id"], out["offset"] = [q for *_, q, _ in made], [o for *_, o in made]
            if with_ids:
                out["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(out)

        id_type = None
        for texts in slices(batches):
            id_type = texts.ids("id").type
            ids, at = words.of(texts)
            keys = texts.ids("id").to_pylist()
            lead = texts.ids("prompt").to_pylist() if prompt else [1] * len(keys)
            for i, key in enumerate(keys):
                packer.add((key, ids[at[i]:at[i + 1]].copy()), int(at[i + 1] - at[i]), lead[i] or 0)
            if packer.rows:
                yield rows()
        if id_type is not None:
            packer.end()
            if packer.rows:
                yield rows()

    held = [F.col(id).alias("id"), F.col(text).alias("text")] + ([F.col(prompt).cast("long").alias("prompt")] if prompt else [])
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(*held).mapInArrow(run, f"`{id}` {kind}, {SCHEMA}" + (", ids array<int>" if with_ids else ""))
