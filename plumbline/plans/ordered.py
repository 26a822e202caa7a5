"""Ordered work inside groups of any size.

A group larger than `chunk_rows` is cut into contiguous ranges of its order column. The cut points
come from one approximate-quantile aggregate over the oversized groups only and are fixed as
literals before the plan is built, so every branch and every retried task sees the same chunks.
Groups below the limit are one chunk, and when no group exceeds it the plan is the plain one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F, types as T

CHUNK_ROWS = 1_000_000
FRACTIONS = 4096
CHUNK = "_chunk"


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys with NULL equal to NULL: rows without a key are a group like any other."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _cut_points(df: DataFrame, keys: Sequence[str], order: str, chunk_rows: int) -> DataFrame | None:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_rows)
    # at most total_rows / chunk_rows rows: small control data, never the table
    big = sizes.collect()
    if not big:
        return None
    spark = df.sparkSession
    fields = [df.schema[k] for k in keys]
    hot = spark.createDataFrame(
        [tuple(r[k] for k in keys) + (r["_n"],) for r in big],
        T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("_n", T.LongType())]),
    )
    fractions = [i / FRACTIONS for i in range(1, FRACTIONS)]
    cuts = (
        match(df.select(*keys, order), F.broadcast(hot), keys)
        .groupBy(*keys, "_n")
        .agg(F.percentile_approx(order, F.array(*[F.lit(f) for f in fractions]), F.lit(FRACTIONS * 10)).alias("_q"))
    )
    # a group of n rows needs about n / chunk_rows cuts, not all the fractions
    stride = F.greatest(F.lit(1), F.floor(F.lit(FRACTIONS) * chunk_rows / F.col("_n"))).cast("int")
    cuts = cuts.withColumn("_stride", stride).select(
        *keys, F.array_distinct(F.filter("_q", lambda x, i: (i + 1) % F.col("_stride") == 0)).alias("_cuts"))
    rows = cuts.collect()
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields]
                          + [T.StructField("_cuts", T.ArrayType(df.schema[order].dataType))])
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def with_chunks(df: DataFrame, keys: Sequence[str], order: str,
                chunk_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Add `_chunk`; the flag tells whether any group was really cut."""
    cuts = _cut_points(df, keys, order, chunk_rows or CHUNK_ROWS)
    if cuts is None:
        return df.withColumn(CHUNK, F.lit(0)), False
    step = 64
    coarse = F.filter("_cuts", lambda c, i: i % step == 0)
    below = lambda arr: F.size(F.filter(arr, lambda c: c < F.col(order)))
    out = match(df, F.broadcast(cuts), keys, "left")
    out = out.withColumn("_b", F.when(F.col("_cuts").isNotNull(), below(coarse)))
    fine = F.slice("_cuts", (F.col("_b") - 1) * step + 1, step)
    chunk = (F.when(F.col("_cuts").isNull() | (F.col("_b") == 0), F.lit(0))
             .otherwise((F.col("_b") - 1) * step + below(fine)))
    return out.select(*df.columns, chunk.cast("int").alias(CHUNK)), True


def _chunk_window(keys: Sequence[str]) -> W:
    return W.partitionBy(*keys).orderBy(CHUNK)


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, name: str = "ordinal",
                chunk_rows: int | None = None) -> DataFrame:
    """row_number() over (keys, order) for groups of any size."""
    chunked, cut = with_chunks(df, keys, order, chunk_rows)
    if not cut:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("long"))
    local = F.row_number().over(W.partitionBy(*keys, CHUNK).orderBy(order))
    counts = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(_chunk_window(keys).rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*keys, CHUNK, F.coalesce(before, F.lit(0)).alias("_before"))
    return (match(chunked.withColumn("_local", local), offsets, [*keys, CHUNK])
            .select(*df.columns, (F.col("_local") + F.col("_before")).cast("long").alias(name)))


def neighbours(df: DataFrame, keys: Sequence[str], order: str, column: str,
               previous: str | None = None, following: str | None = None,
               chunk_rows: int | None = None) -> DataFrame:
    """Value of `column` on the previous / following row of the group."""
    chunked, cut = with_chunks(df, keys, order, chunk_rows)
    parts = [*keys, CHUNK] if cut else list(keys)
    win = W.partitionBy(*parts).orderBy(order)
    boxed = F.struct(F.col(column).alias("v"))
    out = chunked if cut else df
    if previous:
        out = out.withColumn("__n_p", F.lag(boxed).over(win))
    if following:
        out = out.withColumn("__n_f", F.lead(boxed).over(win))
    if cut:
        ends = chunked.groupBy(*parts).agg(F.min_by(boxed, order).alias("_first"), F.max_by(boxed, order).alias("_last"))
        ends = ends.select(*parts, F.lag("_last").over(_chunk_window(keys)).alias("__n_pe"),
                           F.lead("_first").over(_chunk_window(keys)).alias("__n_fe"))
        out = match(out, ends, parts)
    else:
        out = out.withColumn("__n_pe", F.lit(None)).withColumn("__n_fe", F.lit(None))
    if previous:
        out = out.withColumn(previous, F.coalesce("__n_p", "__n_pe")["v"] if cut else F.col("__n_p.v")).drop("__n_p")
    if following:
        out = out.withColumn(following, F.coalesce("__n_f", "__n_fe")["v"] if cut else F.col("__n_f.v")).drop("__n_f")
    return out.select(*df.columns, *[n for n in (previous, following) if n])


def running_last(df: DataFrame, keys: Sequence[str], order: str, column: str, name: str,
                 chunk_rows: int | None = None) -> DataFrame:
    """Latest non-null value at or before each row of the group."""
    chunked, cut = with_chunks(df, keys, order, chunk_rows)
    upto = lambda ks: W.partitionBy(*ks).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    if not cut:
        return df.withColumn(name, F.last(column, ignorenulls=True).over(upto(keys)))
    parts = [*keys, CHUNK]
    lasts = chunked.groupBy(*parts).agg(
        F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_v"))
    carry = F.last("_v", ignorenulls=True).over(_chunk_window(keys).rowsBetween(W.unboundedPreceding, -1))
    lasts = lasts.select(*parts, carry.alias("_carry"))
    return (match(chunked, lasts, parts)
            .select(*df.columns, F.coalesce(F.last(column, ignorenulls=True).over(upto(parts)), F.col("_carry")).alias(name)))


def positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """1-based position of every row in one global order, without one task seeing all rows.

    The sorted table is written to the checkpoint folder, so that partition numbers are facts when
    the counts of earlier partitions are added.
    """
    from plumbline.plans.lineage import cut
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_ix", F.monotonically_increasing_id()))
    part = F.shiftright("_ix", 33).alias("_part")
    local = F.col("_ix").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition of the sort
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = ordered.withColumn("_part", F.shiftright("_ix", 33)).join(F.broadcast(before.drop("_n")), "_part")
    return out.select(*df.columns, (local + F.col("_before") + 1).cast("long").alias(name))
