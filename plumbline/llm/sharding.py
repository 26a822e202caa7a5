"""Histogram sort into shards of near-equal bytes.

Rows are ordered by a 64-bit key: its upper half comes from the group (equal texts), its lower half from the id, so copies
lie side by side and even a group that holds a third of all rows can be cut. Splitters are found by counting, over all
partitions, the exact bytes below candidate keys and narrowing the candidates round by round until each is within
tolerance (or one row decides). Then rows are exchanged once, into ranges of bounded row count; the exact counts below
the range boundaries give gapless slots without gathering a shard in one task.

Null groups and ids are values of their own; identical rows keep any order among themselves; an empty table gives an
empty result; a null size counts as zero. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.kit import fresh, keep

PROBES = 32
LOW_HALF = (1 << 32) - 1


def _below(table: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Exact (bytes, rows) with a key below each probe: counted per partition, then summed over at most len(probes) + 1 bins."""
    cuts = np.array(probes, np.int64)

    def count(batches):
        size, rows = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(cuts, b.column(0).to_numpy(zero_copy_only=False), "right")
            np.add.at(size, at, b.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"bin": some, "size": size[some], "n": rows[some]})

    binned = table.mapInArrow(count, "bin long, size long, n long").groupBy("bin").agg(F.sum("size"), F.sum("n")).collect()
    size, rows = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
    for b, s, n in binned:
        size[b], rows[b] = s, n
    return {p: (int(s), int(n)) for p, s, n in zip(probes, np.cumsum(size)[:-1], np.cumsum(rows)[:-1], strict=True)}


def splitters(table: DataFrame, targets: list[tuple[float, float]], lowest: int, highest: int, size: int, rows: int) -> list[int]:
    """Keys whose exact bytes below are within tolerance of each (target, tolerance); table has columns (key, size)."""
    known = {lowest: (0, 0), highest + 1: (size, rows)}
    chosen: list[int | None] = [None] * len(targets)
    while True:
        order = sorted(known)
        probes: set[int] = set()
        sizes = [known[k][0] for k in order]
        for i, (target, tolerance) in enumerate(targets):
            if chosen[i] is not None:
                continue
            j = min(max(bisect.bisect_right(sizes, target), 1), len(order) - 1)
            low, high = order[j - 1], order[j]
            best = min((low, high), key=lambda k: (abs(known[k][0] - target), k))
            if abs(known[best][0] - target) <= tolerance or high - low <= 1 or known[high][1] - known[low][1] <= 1:
                chosen[i] = best
            else:
                probes |= {low + (high - low) * p // (PROBES + 1) for p in range(1, PROBES + 1)} - {low, high}
        if not probes:
            return [c for c in chosen if c is not None]
        known |= _below(table, sorted(probes))


def shard(df: DataFrame, shards: int = 24, size: str = "size", group: str = "group", id: str = "doc_id",
          tolerance: float = 0.001, rows_per_range: int = 100_000) -> DataFrame:
    """All columns of df with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard)."""
    df = df.drop(*[c for c in ("shard", "slot") if c in df.columns and c not in (size, group, id)])
    key, place = fresh(df, "_key"), fresh(df, "_place")
    high = F.xxhash64(F.lit(7), F.col(group)).bitwiseAND(F.lit(~LOW_HALF))
    keyed = df.withColumn(key, high.bitwiseOR(F.xxhash64(F.lit(11), F.col(id)).bitwiseAND(F.lit(LOW_HALF))))
    table = keep(keyed.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")))
    total, n, lowest, highest = table.agg(F.sum("size"), F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    if not n:
        return df.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    total = total or 0
    ranges = max(1, -(-n // rows_per_range))
    ends = splitters(table, [(total * i / shards, tolerance * total / shards) for i in range(1, shards)], lowest, highest, total, n)
    extra = splitters(table, [(total * i / ranges, 0.1 * total / ranges) for i in range(1, ranges)], lowest, highest, total, n)
    # exact rows below every boundary; several shards may share a boundary where fewer rows than shards exist
    cuts = sorted({*ends, *extra} - {lowest, highest + 1})
    below = _below(table, cuts) if cuts else {}
    starts = [lowest, *cuts]
    rows_at = [0, *(below[c][1] for c in cuts)]
    owner = [bisect.bisect_right(ends, s) for s in starts]  # ends at or below the range's first key
    first_of: dict[int, int] = {}
    for k, o in enumerate(owner):
        first_of.setdefault(o, rows_at[k])
    cut_keys, shard_of = np.array(cuts, np.int64), np.array(owner, np.int32)
    base = np.array([rows_at[k] - first_of[o] for k, o in enumerate(owner)], np.int64)

    @F.pandas_udf("range int, shard int, base long")
    def placed(keys: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(cut_keys, keys.to_numpy(), "right")
        return pd.DataFrame({"range": at.astype(np.int32), "shard": shard_of[at], "base": base[at]})

    spread = keyed.withColumn(place, placed(F.col(key)))
    within = W.partitionBy(f"{place}.range").orderBy(key, id)
    return (spread.withColumn("shard", F.col(f"{place}.shard"))
            .withColumn("slot", F.col(f"{place}.base") + F.row_number().over(within) - 1).drop(key, place))
