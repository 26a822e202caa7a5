"""Reference graphs: closures over edge tables in few rounds.

All pairs: a shortest path of more than n and at most 2n edges splits at its n-th node, so the pairs of exactly n edges joined
with all shorter ones give the next, and the reach doubles with every round. From given sources: runs of nodes with one
edge in and one out are bridged first, by pointers that double, so that a round crosses a whole run; the nodes inside
a run get their depth from its head afterwards. Every round is a join of what is new, written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.lineage import cut


def _hops(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct()


def _all_pairs(hops: DataFrame) -> DataFrame:
    """(a, b, depth) for every pair with a path, the shortest depth of each."""
    parts, span = [cut(hops.withColumn("depth", F.lit(1)))], 1
    while True:
        found = reduce(DataFrame.unionByName, parts)
        exact = parts[-1].where(F.col("depth") == span).select("a", F.col("b").alias("via"), F.col("depth").alias("far"))
        longer = (exact.join(found.select(F.col("a").alias("via"), "b", "depth"), "via").groupBy("a", "b").agg(F.min(F.col("far") + F.col("depth")).alias("depth"))
                  .join(found, ["a", "b"], "left_anti"))
        newest = cut(longer)
        if newest.isEmpty():
            return found
        parts.append(newest)
        span *= 2


def _bridged(hops: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, length): edges and bridged runs between nodes that are not inside a run; and (head, b, length) of the nodes inside."""
    ins = hops.groupBy(F.col("b").alias("n")).agg(F.count(F.lit(1)).alias("ins"), F.min("a").alias("before"))
    outs = hops.groupBy(F.col("a").alias("n")).agg(F.count(F.lit(1)).alias("outs"), F.min("b").alias("after"))
    inner = ins.where("ins = 1").join(outs.where("outs = 1"), "n").join(starts.select(F.col("a").alias("n")).distinct(), "n", "left_anti")
    inner = cut(inner.select("n", "before", "after"))
    up = cut(inner.select("n", F.col("before").alias("head"), F.lit(1).alias("length")))
    names = inner.select(F.col("n").alias("head"))
    for _ in range(inner.count().bit_length() + 1):  # a ring of inner nodes has no head and is not reached
        open_ = up.join(names, "head", "left_semi")
        if open_.isEmpty():
            break
        further = up.select(F.col("n").alias("head"), F.col("head").alias("_head"), F.col("length").alias("_length"))
        up = cut(up.join(further, "head", "left").select("n", F.coalesce("_head", "head").alias("head"), (F.col("length") + F.coalesce("_length", F.lit(0))).alias("length")))
    up = up.join(names, "head", "left_anti")
    last = up.join(inner.select("n", "after"), "n").join(names.select(F.col("head").alias("after")), "after", "left_anti")
    plain = hops.join(names.select(F.col("head").alias("a")), "a", "left_anti").join(names.select(F.col("head").alias("b")), "b", "left_anti")
    links = plain.withColumn("length", F.lit(1)).unionByName(last.select(F.col("head").alias("a"), F.col("after").alias("b"), (F.col("length") + 1).alias("length")))
    return cut(links.groupBy("a", "b").agg(F.min("length").alias("length"))), up.select("head", F.col("n").alias("b"), "length")


def _from_starts(hops: DataFrame, starts: DataFrame) -> DataFrame:
    """(a, b, depth) from the given sources alone."""
    starts = starts.distinct()
    links, inside = _bridged(hops, starts)
    found = newest = cut(starts.select("a", F.col("a").alias("b"), F.lit(0).alias("depth")))
    rounds = 0
    while True:
        step = (newest.select("a", F.col("b").alias("via"), "depth").join(links.select(F.col("a").alias("via"), "b", "length"), "via")
                .groupBy("a", "b").agg(F.min(F.col("depth") + F.col("length")).alias("depth")))
        known = found.groupBy("a", "b").agg(F.min("depth").alias("_known"))
        newest = cut(step.join(known, ["a", "b"], "left").where("_known is null or depth < _known").drop("_known"))
        if newest.isEmpty():
            break
        found = found.unionByName(newest)
        rounds += 1
        if rounds % 8 == 0:
            found = cut(found.groupBy("a", "b").agg(F.min("depth").alias("depth")))
    best = found.groupBy("a", "b").agg(F.min("depth").alias("depth"))
    within = best.select("a", F.col("b").alias("head"), "depth").join(inside, "head").select("a", "b", (F.col("depth") + F.col("length")).alias("depth"))
    return best.unionByName(within)


def closure(edges: DataFrame, src: str = "head", dst: str = "member", starts: DataFrame | None = None,
            abstract: DataFrame | None = None) -> DataFrame:
    """All (src, dst, depth) pairs reachable along edges, cycles allowed, shortest depth kept.

    Names in `abstract` are walked through but not reported. `starts` limits the sources.
    """
    hops = cut(_hops(edges, src, dst))
    found = _all_pairs(hops) if starts is None else _from_starts(hops, starts.select(F.col(starts.columns[0]).alias("a")).where("a is not null"))
    out = found.where("a <> b")
    if abstract is not None:
        out = out.join(abstract.select(F.col(abstract.columns[0]).alias("b")).distinct(), "b", "left_anti")
    return out.select(F.col("a").alias(src), F.col("b").alias(dst), "depth")


def all_pairs(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(a, b, depth) for every pair with a path; names on a cycle reach themselves."""
    return _all_pairs(_hops(edges, src, dst))


def derived_types(edges: DataFrame, base: str, blocked: Sequence[str] = (), kind: str = "kind") -> DataFrame:
    """Names reaching `base` through edges (name, base, kind) none of which is of a blocked kind."""
    usable = edges.where(~F.col(kind).isin(*blocked)) if blocked else edges
    start = edges.sparkSession.createDataFrame([(base,)], "base string")
    return closure(usable.select(F.col("base"), F.col("name")), "base", "name", start).select("name", "depth")


def include_closure(edges: DataFrame, roots: DataFrame, available: DataFrame) -> dict[str, DataFrame]:
    """Breadth-first reach over edges(src, dst, namespace) from roots(doc).

    Returns reached (doc, depth), missing (documents named but not available) and conflict
    (documents without a namespace of their own that were pulled into more than one).
    """
    links = edges.join(available.select(F.col("doc").alias("src")), "src", "left_semi")
    walked = closure(links, "src", "dst", roots)
    reached = (walked.select(F.col("dst").alias("doc"), "depth")
               .unionByName(roots.select(F.col("doc"), F.lit(0).alias("depth"))).groupBy("doc").agg(F.min("depth").alias("depth")))
    missing = reached.join(available, "doc", "left_anti")
    used = links.join(reached.select(F.col("doc").alias("src")), "src", "left_semi")
    conflict = (used.groupBy(F.col("dst").alias("doc")).agg(F.count_distinct(F.coalesce("namespace", F.lit(""))).alias("namespaces"))
                .where("namespaces > 1"))
    return {"reached": reached, "missing": missing, "conflict": conflict}
