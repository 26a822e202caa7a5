"""Shared helpers of the text operators: Arrow slices, word hashing with numpy, tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on. Bounds the memory of a task; a longer document is a step of its own.
STEP_BYTES = 4 << 20

#: White space of the word pattern [^\x20\x09-\x0D]+.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(BLANKS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(column: str, k: int) -> Column:
    """crc32 of a column's text, modulo k; null ids count as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(k)), F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words, so that any of their bits can be used alone."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Texts:
    """A slice of documents: bytes of all texts end to end, and where each begins (nulls are empty)."""

    def __init__(self, batch: pa.RecordBatch, column: str = "text"):
        self.batch = batch
        col = batch.column(column)
        kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
        at = np.frombuffer(col.buffers()[1], kind)[col.offset: col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
        data = col.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self.null = np.asarray(col.is_null())

    def __len__(self) -> int:
        return self.batch.num_rows

    def ids(self, column: str) -> pa.Array:
        return self.batch.column(column)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every word, and for each document the number of words before it (n + 1 values)."""
        inside = _IS_WORD[self.data]
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = self.at[(self.at > 0) & (self.at < n)]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(start, self.at)

    def hashes(self, start: np.ndarray, end: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte ranges, of the lower-cased bytes unless others are given."""
        data = LOWER[self.data] if data is None else data
        up, down = _powers(1 << max(10, int(len(data)).bit_length()))
        total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] ^ (end - start).astype(U))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _RADIX, U)
        down = np.full(n, pow(_RADIX, -1, 1 << 64), U)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES) -> Iterator[Texts]:
    """Runs of whole documents of about `step` bytes of text."""
    for batch in batches:
        at = Texts(batch, column).at
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1)
            yield Texts(batch.slice(i, j - i), column)
            i = j


def shingles(words: np.ndarray, before: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each document and the document of each; a shorter document with words has one."""
    n = len(before) - 1
    count = np.diff(before)
    if not len(words):
        return np.zeros(0, U), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), count)
    left = before[1:][doc] - np.arange(len(words))  # words from here to the end of the document
    total = np.zeros(len(words), U)
    for j in range(k):
        ahead = np.minimum(np.arange(len(words)) + j, len(words) - 1)
        total = mix(total * U(_RADIX) + np.where(left > j, words[ahead], U(0)))
    whole = (left >= k) | ((count[doc] < k) & (left == count[doc]))
    return total[whole], doc[whole]


def binary(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Hash exchange on one key into the given number of partitions."""
    return df.repartition(parts, F.col(key))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A filter of 2^bits flags: set at the top bits of every value of a 64-bit column. Its size does not depend on the data;
    values outside may pass, values inside always do."""

    def pack(batches):
        for b in batches:
            if b.num_rows:
                slots = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint32)
                yield pa.RecordBatch.from_pydict({"slots": binary([slots.tobytes()])})

    found = np.zeros(1 << bits, bool)
    slots = df.select(F.shiftrightunsigned(column, 64 - bits).alias("slot")).distinct()
    for row in slots.mapInArrow(pack, "slots binary").toLocalIterator():
        found[np.frombuffer(row[0], np.uint32)] = True
    return found


def passes(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = int(len(flags)).bit_length() - 1
    return flags[(values.view(U) >> U(64 - bits)).astype(np.int64)]
