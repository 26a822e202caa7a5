"""Join and limit shapes that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

#: Heaviest keys handled by a map-side join. The list is a top-k result, so its size is fixed,
#: and a key outside it holds at most 1/HEAVY_KEYS of the rows.
HEAVY_KEYS = 1000
SALTS = 64


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower()
    units = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1}
    for suffix, factor in units.items():
        if text.endswith(suffix):
            return int(text[: -len(suffix)]) * factor
    return int(text)


def heavy_keys(df: DataFrame, keys: Sequence[str], k: int = HEAVY_KEYS) -> DataFrame:
    """The k most frequent key values; counted with map-side combine, so at most k rows."""
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return (
        df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .orderBy(F.desc("_rows"), *keys).limit(k).select(*keys)
    )


def salt(df: DataFrame, salts: int = SALTS) -> Column:
    """A salt that depends on the row only, so a recomputed task deals the rows the same way."""
    plain = [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()
             and "variant" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")


def skew_join(facts: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner",
              k: int = HEAVY_KEYS, salts: int = SALTS, salted: bool | None = None) -> DataFrame:
    """Equi-join in which no key value of `facts` can make one task the bottleneck.

    A side below the session's broadcast threshold is left to Spark, which broadcasts it after the
    same check. Otherwise the rows of the k heaviest fact keys are dealt over `salts` buckets and
    their (few) side rows are copied to each bucket; every other key joins as it is. Rows without a
    key match nothing and are dealt over the buckets too. Either input is planned once.
    `how` is one of inner, left, left_semi, left_anti.
    """
    keys = list(keys)
    if salted is None:
        salted = planned_bytes(side) > broadcast_limit(side)
    if not salted:
        return facts.join(side, keys, how)
    heavy = F.broadcast(heavy_keys(facts, keys, k).withColumn("_hot", F.lit(True)))
    absent = F.lit(False)
    for key in keys:
        absent = absent | F.col(key).isNull()
    spread = F.col("_hot").isNotNull() | absent
    dealt = facts.withColumn("_bucket", salt(facts, salts)).join(heavy, keys, "left")
    dealt = dealt.withColumn("_salt", F.when(spread, F.col("_bucket")).otherwise(F.lit(0))).drop("_hot", "_bucket")
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = side.join(heavy, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    rank: str | None = None, salts: int = SALTS) -> DataFrame:
    """First n rows of each group. Each salt keeps its own n first, so the last window of a group
    sees at most n * salts rows however large the group is."""
    part = df.withColumn("_salt", salt(df, salts))
    part = part.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)))
    part = part.where(F.col("_rn") <= n).drop("_salt", "_rn")
    name = rank or "_rn"
    out = part.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(name) <= n)
    return out if rank else out.drop("_rn")
