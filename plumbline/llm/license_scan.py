"""License scan: sparse TF-IDF cosine of lines and whole files to templates, then inheritance from directories.

DataFrame functions only. Terms are runs of a-z, 0-9 after lower-casing; idf comes from the templates (a term that none has
gets the highest). A line (header) or a whole text (licence file) carries the licence of the template with the largest cosine
of at least THRESHOLD, ties going to the smaller name. Terms are counted inside the row of their unit, so no text and no term
is exchanged; a text or line whose terms of every template weigh too little to reach the threshold is passed over first.

Directories with licence files give their best one to all documents below that carry none; the nearest ancestor wins. The
joins are on distinct directories, so a directory with a third of all rows is one row of the path table.

Nulls and empty texts carry nothing but may inherit; a null path has no directory. Repeated rows are scanned once and get the
same result each. Without documents the result is empty. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kit import keep

THRESHOLD = 0.8

#: Short notices of known licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Proprietary": "All rights reserved.",
}


def weights(templates: dict[str, str]) -> tuple[dict[str, dict[str, float]], dict[str, float], float]:
    """Unit vectors of the templates, idf of their terms, and idf of other terms."""
    terms = {name: re.findall("[a-z0-9]+", text.lower()) for name, text in templates.items()}
    df: dict[str, int] = {}
    for words in terms.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + len(terms)) / (1 + n)) + 1 for w, n in df.items()}
    vectors = {}
    for name, words in terms.items():
        raw = {w: words.count(w) * idf[w] for w in words}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors[name] = {w: x / norm for w, x in raw.items()}
    return vectors, idf, math.log(1 + len(terms)) + 1


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, parts)


def _in_reach(text: Column, vectors: dict[str, dict[str, float]], known: list[str]) -> Column:
    """Whether the terms a text has of some template weigh enough for THRESHOLD (Cauchy-Schwarz). A line never has more than its text."""

    def enough(held: Column, vector: dict[str, float]) -> Column:
        return _sum([F.when(F.array_contains(held, w), x * x).otherwise(0.0) for w, x in vector.items()]) >= THRESHOLD * THRESHOLD - 1e-6

    held = F.array_intersect(F.split(F.lower(text), "[^a-z0-9]+"), F.array(*map(F.lit, known)))
    return F.exists(F.array(held), lambda h: reduce(lambda x, y: x | y, [enough(h, v) for v in vectors.values()]))


def _squares(ordered: Column) -> Column:
    """Sum of squared term counts of an ordered array: the k-th copy of a term adds 2 k - 1."""

    def step(at: Column, w: Column) -> Column:
        k = F.when(at["last"] == w, at["k"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(w.alias("last"), k.alias("k"), (at["total"] + 2 * k - 1).alias("total"))

    zero = F.lit(0).cast("long")
    return F.aggregate(ordered, F.struct(F.lit("").alias("last"), zero.alias("k"), zero.alias("total")), step, lambda at: at["total"])


def _scored(units: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(key, unit, license, score) of the templates that a unit of text reaches, worked out inside its row."""
    vectors, idf, other = weights(templates)
    known = sorted(idf)
    place = {w: i for i, w in enumerate(known)}
    ordered = units.where(_in_reach(F.col("unit_text"), vectors, known)).select("key", "unit", F.sort_array(_terms(F.col("unit_text"))).alias("terms"))
    split = ordered.select("key", "unit", _squares(F.col("terms")).alias("squares"), F.filter("terms", lambda w: w.isin(known)).alias("held"))
    counted = split.select("key", "unit", "squares", F.transform(F.array(*map(F.lit, known)), lambda w: F.size(F.filter("held", lambda x: x == w)).cast("double")).alias("tf"))
    tf = lambda w: F.col("tf")[place[w]]
    norm = F.sqrt(other * other * F.col("squares") + _sum([(idf[w] ** 2 - other * other) * tf(w) * tf(w) for w in known]))
    normed = counted.select("key", "unit", "tf", norm.alias("norm"))
    each = [F.struct(F.lit(name).alias("license"), F.round(_sum([tf(w) * (idf[w] * x) for w, x in v.items()]) / F.col("norm"), 6).alias("score"))
            for name, v in sorted(vectors.items())]
    return normed.select("key", "unit", F.explode(F.array(*each)).alias("best")).select("key", "unit", "best.license", "best.score").where(F.col("score") >= THRESHOLD)


def _parent(path: Column) -> Column:
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = "path", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(id, path, license, score, licence_file, inherited, inherited_from, effective) of every row."""
    rows = docs.select(F.col(id).alias("id"), F.col(path).alias("path"), F.xxhash64(F.col(id), F.col(path), F.col(text)).alias("key"), F.col(text).alias("text"))
    vectors, idf, _ = weights(templates)
    near = rows.where(_in_reach(F.col("text"), vectors, sorted(idf)))
    units = near.select("key", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("at", "unit_text"))
    found = _scored(units.withColumn("unit", F.col("at") - 1), templates)  # -1: the whole text
    own = keep(found.groupBy("key").agg(
        F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("license"),
        F.min_by("license", F.when(F.col("unit") == -1, F.struct(-F.col("score"), F.col("license")))).alias("file_license")))
    placed = keep(rows.select("id", "path", "key").join(own, "key", "left"))
    given = placed.where("file_license is not null and path is not null").groupBy(_parent(F.col("path")).alias("dir")).agg(
        F.min_by("file_license", "path").alias("inherited"))
    dirs = placed.where("path is not null").select(_parent(F.col("path")).alias("home")).distinct()
    steps = F.split("home", "/")
    above = dirs.withColumn("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))))
    nearest = above.distinct().join(given, "dir").groupBy("home").agg(
        F.max_by("inherited", F.length("dir")).alias("inherited"), F.max_by("dir", F.length("dir")).alias("inherited_from"))
    full = placed.withColumn("home", _parent(F.col("path"))).join(nearest, "home", "left")
    free = F.col("license").isNull()
    return full.select(F.col("id").alias(id), "path", "license", "score", F.col("file_license").isNotNull().alias("licence_file"),
                       F.when(free, F.col("inherited")).alias("inherited"), F.when(free, F.col("inherited_from")).alias("inherited_from"),
                       F.coalesce("license", "inherited").alias("effective"))
