"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled good, unlabelled are rows of the corpus; with the class prior pi the risk of a scorer is
pi * R_positive(+1) + max(0, R_unlabelled(-1) - pi * R_positive(-1)), minimised over a logistic model of text features
(Kiryo et al.). Where the inner term falls below zero, the step climbs it back instead. The prior is the share of positives
among eligible labelled rows, held within PRIOR_RANGE; without a negative label its upper end is taken.

The fit uses at most `sample` positives and `sample` unlabelled rows, those with the smallest id hashes; scoring reads every
whole text. Without positives every score is the prior. Null and empty texts have the features of no words and get a score.
Several labels of one id count as the worst of them. Repeated rows are scored one by one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kit import Texts, shingles, slices

SAMPLE = 8000
PRIOR_RANGE = (0.05, 0.95)
STEPS = 600
RATE = 0.05

#: Byte classes whose shares are features.
CLASSES = {"capitals": range(65, 91), "small": range(97, 123), "digits": range(48, 58), "signs": b"#*$%&<>@^~=+_/\\", "bars": b"|",
           "marks": b"!?", "stops": b".,;:", "wide": range(128, 256), "lines": b"\n", "blanks": b"\x20\x09\x0b\x0c\x0d"}


def features(texts: Texts) -> np.ndarray:
    """One row of numbers per document: shares of byte classes, lengths, repetition."""
    n = len(texts)
    size = np.diff(texts.at)
    start, end, before = texts.words()
    words = np.diff(before)
    per = lambda x, by: x / np.maximum(by, 1)
    cols = [np.log1p(words), np.log1p(size)]
    for members in CLASSES.values():
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        total = np.concatenate([[0], np.cumsum(table[texts.data])])
        cols.append(per(total[texts.at[1:]] - total[texts.at[:-1]], size))
    doc = np.repeat(np.arange(n), words)
    length = end - start
    cols.append(per(np.bincount(doc, length, n), words))
    last = texts.data[end - 1] if len(end) else np.zeros(0, np.uint8)
    kind = np.zeros(256, np.int64)
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    letters = np.concatenate([[0], np.cumsum(kind[texts.data])])
    held = letters[end] - letters[start]
    cols += [per(np.bincount(doc, held == 0, n), words), per(np.bincount(doc, kind[last] == 0, n), words), per(np.bincount(doc, length > 20, n), words)]
    hashed = texts.hashes(start, end)
    for k in (1, 4):
        values, owner = (hashed, doc) if k == 1 else shingles(hashed, before, k)
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        again = np.zeros(len(v), bool)
        again[1:] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
        cols.append(per(np.bincount(o, again, n), np.bincount(o, minlength=n)))
    twin = np.zeros(len(hashed), bool)
    twin[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    cols.append(per(np.bincount(doc, twin, n), words))
    x = np.stack(cols, 1).astype(float)
    bent = np.sqrt(np.abs(x))
    return np.concatenate([x, bent, (words == 0).astype(float)[:, None], (words < 20).astype(float)[:, None]], 1)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.bias, self.mean, self.scale = weights, bias, mean, scale

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss."""
    if not len(positive) or not len(unlabelled):
        width = (positive if len(positive) else unlabelled).shape[-1] if len(positive) or len(unlabelled) else 1
        return Model(np.zeros(width), float(np.log(prior / (1 - prior))), np.zeros(width), np.ones(width))
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w, m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    p, u = (np.concatenate([x, np.ones((len(x), 1))], 1) for x in (p, u))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        # slopes of log(1 + e^-z) for the label +1 and of log(1 + e^z) for -1
        up, down_p, down_u = (sigmoid(zp) - 1) @ p / len(p), sigmoid(zp) @ p / len(p), sigmoid(zu) @ u / len(u)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        slope = prior * up + down_u - prior * down_p if rest >= 0 else prior * down_p - down_u
        slope = slope + 1e-4 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(w[:-1], float(w[-1]), mean, scale)


def _featured(docs: DataFrame, id: str, text: str) -> DataFrame:
    def run(batches):
        for texts in slices(batches):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([texts.ids("id"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "x"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, eligible: Column, id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Model:
    """Fit on bounded samples of eligible rows: labelled good, and any."""
    known = labels.where(eligible & F.col(label).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(label).alias("y"))
    good, seen = known.agg(F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    prior = float(np.clip(good / seen if seen and good < seen else 1.0, *PRIOR_RANGE))
    order = F.xxhash64("id", F.lit(23))
    chosen = known.where("y = 1").orderBy(order, "id").limit(sample).select("id", F.lit(True).alias("good"))
    some = docs.where(eligible).select(F.col(id).alias("id")).orderBy(order, "id").limit(sample).select("id", F.lit(False).alias("good"))
    wanted = F.broadcast(chosen.unionByName(some))  # at most 2 * sample ids
    rows = docs.where(eligible).select(F.col(id).alias("row_id"), F.col(text).alias("row_text")).join(wanted, F.col("row_id") == F.col("id")).drop("id")
    x = {True: [], False: []}
    pairs = rows.select(F.struct("row_id", "good").alias("row"), F.col("row_text"))
    for r in _featured(pairs, "row", "row_text").toLocalIterator():
        x[r.id.good].append(r.x)
    return fit(np.array(x[True]), np.array(x[False]), prior)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row, the share of belief that it is good."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for texts in slices(batches):
            yield pa.RecordBatch.from_arrays([texts.ids("id"), pa.array(held.value.score(features(texts)))], ["id", "score"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id)
