"""Fill-in-the-middle transformation over seekable compressed texts.

`store` keeps each text as independent zstandard frames of about `frame_bytes`, cut between code points, with the number of
code points before every frame. `infill` takes two cut points per text from a hash of its id and puts prefix, suffix and
middle in the order of the form (`psm` or `spm`). Only the frames that hold a cut are decompressed and compressed again;
all others pass into the output as they are, since frames one after another are a valid zstandard stream. Digests of the
output, and of the text rebuilt from output and form alone, are taken frame by frame, so a task holds one compressed text
and a few plain frames, however long the text is. There is no exchange: rows are independent, and the draws depend on
the id only, so a task that runs again makes the same rows.

Null texts are empty. Empty texts and texts that hold a mark stay plain, as do a share of the others. A null id draws as an
empty id would. Repeated rows are transformed once each, and alike. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kit import Texts

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
FRAME_BYTES = 64 << 10
LEVEL = 3
STORED = "n long, marked boolean, frames array<binary>, before array<long>"
FILLED = "prefix_chars long, middle_chars long, frames array<binary>"


def compressed(data: bytes | memoryview) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(data)


def plain(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def cut_frames(data: np.ndarray, frame_bytes: int) -> tuple[list[bytes], list[int], int]:
    """Frames of a text, the code points before each, and the code points of the whole."""
    frames, before, units, at = [], [], 0, 0
    while at < len(data):
        end = min(at + frame_bytes, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:  # inside a code point
            end += 1
        frames.append(compressed(data[at:end].tobytes()))
        before.append(units)
        units += int(np.count_nonzero(data[at:end] & 0xC0 != 0x80))
        at = end
    return frames, before, units


def store(docs: DataFrame, id: str = "doc_id", text: str = "text", marks: Sequence[str] = MARKS, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The id, `n` code points, whether the text holds a mark, its frames, and the code points before each frame."""
    found = re.compile("|".join(re.escape(m) for m in marks).encode())

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one row at a time: a batch of long texts is not held twice
                texts = Texts(batch.slice(i, 1))
                frames, before, n = cut_frames(texts.data, frame_bytes)
                yield pa.RecordBatch.from_arrays(
                    [texts.ids("id"), pa.array([n], pa.int64()), pa.array([found.search(texts.data) is not None]),
                     pa.array([frames], pa.list_(pa.binary())), pa.array([before], pa.list_(pa.int64()))],
                    ["id", "n", "marked", "frames", "before"])

    kind = docs.schema[id].dataType.simpleString()
    held = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return held.mapInArrow(gathered(run), f"id {kind}, {STORED}").withColumnRenamed("id", id)


def gathered(run, rows: int = 1024, size: int = 4 << 20):
    """The batches of `run` put together up to so many rows or bytes."""
    def of(batches):
        held, n, used = [], 0, 0
        for batch in run(batches):
            held.append(batch)
            n, used = n + batch.num_rows, used + batch.nbytes
            if n >= rows or used >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n, used = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return of


def draw(id: str, k: int, seed: int = 1) -> Column:
    """The k-th group of eight hexadecimal digits of the sha256 of `seed:id`, as a number; k from 0 to 7."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long")


def planned(stored: DataFrame, id: str = "doc_id", plain_share: int = 10, spm_share: int = 20, seed: int = 1) -> DataFrame:
    """Columns `form` (plain, psm or spm) and, where it is not plain, `first` and `second`: code points before the two cuts."""
    one, two = (F.pmod(draw(id, k, seed), F.col("n") + 1) for k in (0, 1))
    stays = (F.col("n") == 0) | F.col("marked") | (F.pmod(draw(id, 2, seed), F.lit(100)) >= 100 - plain_share)
    form = F.when(stays, "plain").when(F.pmod(draw(id, 3, seed), F.lit(100)) < spm_share, "spm").otherwise("psm")
    return (stored.withColumn("form", form).withColumn("first", F.when(F.col("form") != "plain", F.least(one, two)))
            .withColumn("second", F.when(F.col("form") != "plain", F.greatest(one, two))))


class Seekable:
    """Frames of one text with the code points before each; holds the last plain frame."""

    def __init__(self, frames: list[bytes], before: list[int], n: int):
        self.frames, self.before, self.n = frames, [*before, n], n
        self.at, self.held = -1, b""

    def frame(self, k: int) -> bytes:
        if k != self.at:
            self.at, self.held = k, plain(self.frames[k])
        return self.held

    def byte(self, k: int, unit: int) -> int:
        """Byte of the frame where code point `unit` of the text begins; the frame's length where it lies behind."""
        if unit >= self.before[k + 1]:
            return len(self.frame(k))
        return int(np.flatnonzero(np.frombuffer(self.frame(k), np.uint8) & 0xC0 != 0x80)[unit - self.before[k]])

    def span(self, start: int, end: int) -> Iterator[tuple[bool, bytes]]:
        """Code points [start, end): whole frames as they are (True), parts of cut frames as plain bytes (False)."""
        k = max(0, bisect_right(self.before, start) - 1)
        while start < end:
            stop = min(end, self.before[k + 1])
            if start == self.before[k] and stop == self.before[k + 1]:
                yield True, self.frames[k]
            else:
                yield False, self.frame(k)[self.byte(k, start):self.byte(k, stop)]
            start, k = stop, k + 1


def arranged(text: Seekable, form: str, first: int, second: int, marks: Sequence[bytes]) -> list[bytes]:
    """Frames of the output: marks and cut parts that meet are compressed together."""
    if form == "plain":
        return text.frames
    pre, suf, mid = (marks[0], 0, first), (marks[1], second, text.n), (marks[2], first, second)
    out, open_part = [], []

    def close():
        if open_part:
            out.append(compressed(b"".join(open_part)))
            open_part.clear()

    for mark, start, end in (pre, suf, mid) if form == "psm" else (suf, pre, mid):
        open_part.append(mark)
        for whole, data in text.span(start, end):
            if whole and len(text.frames) > 1:
                close()
                out.append(data)
            else:
                open_part.append(plain(data) if whole else data)
    close()
    return out


def marked_at(frames: list[bytes], marks: Sequence[bytes], digest) -> dict[bytes, int]:
    """First byte of every mark in the output; the digest takes in all of it on the way."""
    places: dict[bytes, int] = {}
    longest = max(len(m) for m in marks)
    tail, seen = b"", 0
    for frame in frames:
        data = plain(frame)
        digest.update(data)
        window = tail + data
        for m in marks:
            if m not in places and (at := window.find(m)) >= 0:
                places[m] = seen - len(tail) + at
        seen += len(data)
        tail = window[len(window) - min(len(window), longest - 1):]
    return places


def bytes_of(frames: list[bytes], start: int, end: int | None) -> Iterator[bytes]:
    """Bytes [start, end) of the output; frames outside are skipped by the size in their header."""
    at = 0
    for frame in frames:
        size = zstandard.frame_content_size(frame)
        if at + size > start and (end is None or at < end):
            yield plain(frame)[max(0, start - at):None if end is None else end - at]
        at += size


def digests(frames: list[bytes], form: str, marks: Sequence[bytes]) -> tuple[str, str]:
    """sha256 of the output and of the text rebuilt from output and form."""
    output, restored = hashlib.sha256(), hashlib.sha256()
    if form == "plain":
        for frame in frames:
            output.update(plain(frame))
        return output.hexdigest(), output.hexdigest()
    places = marked_at(frames, marks, output)
    order = sorted(marks, key=places.__getitem__)
    for m in (marks[0], marks[2], marks[1]):  # prefix, middle, suffix
        k = order.index(m)
        for data in bytes_of(frames, places[m] + len(m), places[order[k + 1]] if k + 1 < len(order) else None):
            restored.update(data)
    return output.hexdigest(), restored.hexdigest()


def infill(stored: DataFrame, id: str = "doc_id", marks: Sequence[str] = MARKS, plain_share: int = 10, spm_share: int = 20, seed: int = 1,
           with_frames: bool = True, with_digests: bool = True) -> DataFrame:
    """Per text: id, n, form, prefix_chars, middle_chars (null where plain), with_frames the frames of the output (`unpacked`
    turns them into text), with_digests output_sha256 and restored_sha256."""
    signs = [m.encode() for m in marks]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, frames, before, form, first, second = (row.column(c)[0].as_py() for c in ("n", "frames", "before", "form", "first", "second"))
                output = arranged(Seekable(frames, before, n), form, first, second, signs)
                out = {"id": row.column("id"), "n": row.column("n"), "form": row.column("form"), "prefix_chars": row.column("first"),
                       "middle_chars": pa.array([None if first is None else second - first], pa.int64())}
                if with_frames:
                    out["frames"] = pa.array([output], pa.list_(pa.binary()))
                if with_digests:
                    out["output_sha256"], out["restored_sha256"] = ([x] for x in digests(output, form, signs))
                yield pa.RecordBatch.from_pydict(out)

    kind = stored.schema[id].dataType.simpleString()
    columns = (f"id {kind}, n long, form string, prefix_chars long, middle_chars long" + (", frames array<binary>" if with_frames else "")
               + (", output_sha256 string, restored_sha256 string" if with_digests else ""))
    plan = planned(stored, id, plain_share, spm_share, seed).select(F.col(id).alias("id"), "n", "frames", "before", "form", "first", "second")
    return plan.mapInArrow(gathered(run), columns).withColumnRenamed("id", id)


def unpacked(df: DataFrame, frames: str = "frames", text: str = "text") -> DataFrame:
    """The column of frames replaced by the text they hold."""
    @F.pandas_udf("string")
    def joined(col):
        return col.map(lambda fs: b"".join(plain(bytes(f)) for f in fs).decode())

    return df.withColumn(text, joined(F.col(frames))).drop(*({frames} - {text}))
