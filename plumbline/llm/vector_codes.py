"""Vector codes: each quarter of a vector is replaced by the nearest of 256 entries, learnt by integer Lloyd rounds.

Components become floor(1024 * x), so every distance, sum and mean is a whole number and results do not depend on the order
of rows or tasks. A row keeps, for each part, its entry, an upper bound of the distance to it, and a lower bound of the
distance to the other entries of each group of entries, every bound with the stamp of the round it was computed in. The
codebooks of all rounds are kept; in a later round a bound moves by the true net displacement of an entry since its stamp
(the norm of the summed moves, which is at most the sum of the norms of the moves). Only groups whose bound does not
exceed the distance to the own entry are scanned again, exactly. Bounds are rounded outwards, so no nearest entry is missed.

A round is one pass over the state table: every task writes its rows and one row of sums per entry, which Spark adds up;
the driver gets 256 entries a part, whatever the number of rows. Rounds alternate between two tables in the shared folder,
each outliving lost executors; both are emptied at the end.

Rows with a null vector, or null, NaN or infinite components are dropped. Components beyond +-`bound` are taken as the bound,
which keeps squares exact. Vectors shorter than the longest (rounded up to a multiple of the parts) count as filled up with
zeros. Equal ids start in the order of their components, null ids last; repeated rows get one code each; with fewer than 256
rows there are fewer entries. Null labels form one group. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kit import keep, shared_folder

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 4, 256, 4, 8, 1024
BOUND = 1 << 26
#: Labels with more than a thousandth of all rows; there are fewer than this many.
HEAVY = 1000


def whole_numbers(df: DataFrame, id: str, vector: str, label: str | None, scale: int = SCALE, bound: int = BOUND) -> DataFrame:
    """id, label and the whole-number components of the rows with a usable vector."""
    unusable = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(bound))), F.lit(-float(bound)))).cast("int"))
    return (df.where(F.col(vector).isNotNull() & ~unusable)
            .select(F.col(id).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), scaled.alias("x")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def exact(x: np.ndarray, book: np.ndarray) -> bool:
    """Whether squared distances are exact in floating point."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    return 4 * top * top * max(1, x.shape[1]) < 1 << 53


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry."""
    if exact(x, book):
        x, book = x.astype(float), book.astype(float)
    return (((x * x).sum(1)[:, None] - 2 * (x @ book.T)) + (book * book).sum(1)).astype(np.int64)


def above(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d).astype(np.float32), np.float32(np.inf))


def below(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d).astype(np.float32), np.float32(-np.inf))


FAR = np.iinfo(np.int64).max


def two_least(d: np.ndarray, members: np.ndarray, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least distance, its entry (lowest index) and the least distance of the others, without the entry to skip."""
    d = np.where(members == skipped[:, None], FAR, d)
    at = d.argmin(1)
    least = d[np.arange(len(d)), at]
    d[np.arange(len(d)), at] = FAR
    return least, members[at], d.min(1)


class Part:
    """One part position in one round: codebook history as net displacements, and the groups of entries."""

    def __init__(self, history: list[np.ndarray]):
        self.round = len(history) - 1
        self.book = history[-1]
        spread = history[0][:, history[0].var(0).argmax()] if history[0].size else np.zeros(len(history[0]))
        self.groups = [np.sort(g) for g in np.array_split(np.argsort(spread, kind="stable"), min(GROUPS, len(spread)))]
        self.group_of = np.zeros(len(spread), np.int64)
        for g, members in enumerate(self.groups):
            self.group_of[members] = g
        self.moved = np.array([np.sqrt(((self.book - old).astype(float) ** 2).sum(1)) for old in history])  # round stamp, entry
        self.group_moved = np.array([[m[g].max() for g in self.groups] for m in self.moved])  # round stamp, group

    def start(self, x: np.ndarray) -> tuple:
        """State of rows without bounds: one full scan."""
        n = len(x)
        d = squares(x, self.book)
        code = d.argmin(1)
        own = d[np.arange(n), code]
        d[np.arange(n), code] = FAR
        lower = np.stack([below(d[:, g].min(1)) for g in self.groups], 1)
        stamp = np.full((n, len(self.groups)), self.round, np.int8)
        return code, above(own), np.full(n, self.round, np.int8), lower, stamp, np.full(n, len(self.book))

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, upper_at: np.ndarray, lower: np.ndarray, lower_at: np.ndarray) -> tuple:
        """State after a move of the codebook: bounds first, exact scans of the groups they leave open."""
        code, upper, upper_at, lower, lower_at = (a.copy() for a in (code, upper, upper_at, lower, lower_at))
        reach = upper + self.moved[upper_at, code]
        floor = lower - self.group_moved[lower_at, np.arange(len(self.groups))]
        open_rows = np.flatnonzero((floor <= reach[:, None]).any(1))
        scans = np.zeros(len(x), np.int64)
        scans[open_rows] = 1
        old = code[open_rows]
        own = ((x[open_rows] - self.book[old]) ** 2).sum(1)
        upper[open_rows], upper_at[open_rows] = above(own), self.round
        left = floor[open_rows] <= upper[open_rows, None]
        best, chosen, found = own.copy(), old.copy(), []
        for g, members in enumerate(self.groups):
            some = np.flatnonzero(left[:, g])
            if not len(some):
                continue
            rows = open_rows[some]
            scans[rows] += len(members)
            least, entry, next_least = two_least(squares(x[rows], self.book[members]), members, old[some])
            found.append((g, some, least, entry, next_least))
            better = (least < best[some]) | ((least == best[some]) & (entry < chosen[some]))
            best[some[better]], chosen[some[better]] = least[better], entry[better]
        for g, some, least, entry, next_least in found:
            lower[open_rows[some], g] = below(np.where(entry == chosen[some], next_least, least))
            lower_at[open_rows[some], g] = self.round
            floor[open_rows[some], g] = lower[open_rows[some], g]
        gone = np.flatnonzero(chosen != old)  # the entry left behind is now one of the others of its group
        rows, g = open_rows[gone], self.group_of[old[gone]]
        lower[rows, g] = np.nextafter(np.minimum(floor[rows, g], below(own[gone])).astype(np.float32), np.float32(-np.inf))
        lower_at[rows, g] = self.round
        code[open_rows] = chosen
        upper[rows] = above(best[gone])
        return code, upper, upper_at, lower, lower_at, scans


STATE = "x array<int>, code binary, upper binary, upper_at binary, lower binary, lower_at binary, scans long"


def _rows(column: pa.Array, kind, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, PARTS, -1).copy()


def _packed(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in a.reshape(len(a), -1)], pa.binary())


def one_round(table: DataFrame, history: list[np.ndarray], width: int, last: bool) -> DataFrame:
    """The rows of the next state with one more row of sums per task; after the last round code, error and scans alone."""
    kinds = [f"{c} {table.schema[c].dataType.simpleString()}" for c in ("id", "label")]
    w, k = width // PARTS, history[0].shape[1]

    def run(batches):
        parts = [Part([h[p] for h in history]) for p in range(PARTS)]
        sums = np.zeros((PARTS, k, w + 1), np.int64)
        empty = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = matrix(b.column("x"), width).reshape(n, PARTS, w)
            if len(history) == 1:
                made = [part.start(x[:, p]) for p, part in enumerate(parts)]
            else:
                held = [_rows(b.column(c), kind, n) for c, kind in (("code", np.uint8), ("upper", np.float32), ("upper_at", np.int8), ("lower", np.float32), ("lower_at", np.int8))]
                made = [part.again(x[:, p], held[0][:, p, 0].astype(np.int64), held[1][:, p, 0], held[2][:, p, 0], held[3][:, p], held[4][:, p])
                        for p, part in enumerate(parts)]
            code = np.stack([m[0] for m in made], 1).astype(np.uint8)
            scans = sum(m[5] for m in made) + (0 if len(history) == 1 else b.column("scans").to_numpy())
            if last:
                error = sum(((x[:, p] - part.book[made[p][0]]) ** 2).sum(1) for p, part in enumerate(parts))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error), pa.array(scans)],
                                                 ["id", "label", "code", "error", "scans"])
                continue
            for p in range(PARTS):
                np.add.at(sums[p, :, :w], made[p][0], x[:, p])
                sums[p, :, w] += np.bincount(made[p][0], minlength=k)
            arrays = [b.column("id"), b.column("label"), b.column("x"), _packed(code), *(_packed(np.stack([m[i] for m in made], 1)) for i in range(1, 5)), pa.array(scans)]
            names = ["id", "label", "x", "code", "upper", "upper_at", "lower", "lower_at", "scans"]
            empty = empty or [(name, a.type) for name, a in zip(names, arrays, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.binary())], [*names, "sums"])
        if empty:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for _, t in empty), pa.array([sums.tobytes()], pa.binary())], [*(name for name, _ in empty), "sums"])

    columns = "code string, error long, scans long" if last else STATE + ", sums binary"
    return table.mapInArrow(run, ", ".join([*kinds, columns]))


def moved(book: np.ndarray, state: DataFrame) -> np.ndarray:
    """The codebook of the next round: componentwise floored means, unused entries as they were."""
    def spread(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                values = np.frombuffer(data, np.int64)
                some = np.flatnonzero(values)
                yield pa.RecordBatch.from_pydict({"at": some, "total": values[some]})

    added = state.where("sums is not null").select("sums").mapInArrow(spread, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    sums = np.zeros((*book.shape[:2], book.shape[2] + 1), np.int64)
    sums.reshape(-1)[added["at"].to_numpy()] = added["total"].to_numpy()
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), book)


def learn(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str | None = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, label, code, error, scans: exact distances computed) and the final codebooks (part, entry, position)."""
    spark = df.sparkSession
    rows = whole_numbers(df, id, vector, label)
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return rows.select("id", "label", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "scans"))), np.zeros((PARTS, 0, 0), np.int64)
    width = -(-longest // PARTS) * PARTS
    first = rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).toArrow()
    start = matrix(first["x"].combine_chunks(), width)
    history = [np.ascontiguousarray(start.reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2))]
    folder, schema = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}", None
    for k in range(rounds):
        step = one_round(rows, history, width, last=False)
        schema = step.schema
        step.write.mode("overwrite").parquet(f"{folder}/{k % 2}")
        state = spark.read.schema(schema).parquet(f"{folder}/{k % 2}")
        history.append(moved(history[-1], state))
        rows = state.where("sums is null").drop("sums")
    coded = keep(one_round(rows, history, width, last=True))
    for k in range(min(rounds, 2)):  # an empty table in their place frees the space
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{k}")
    return coded, history[-1]


def label_errors(coded: DataFrame) -> DataFrame:
    """Columns `label_error`: the error summed over equal labels. Labels that hold more than a thousandth of the rows, fewer
    than a thousand of them, are sent to every task; rows of the others are exchanged, so no task gets more of a label."""
    totals = keep(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")))
    n = totals.agg(F.sum("rows")).first()[0] or 0
    heavy = totals.where(F.col("rows") * HEAVY > n).select(F.col("label").alias("heavy"), F.col("label_error").alias("heavy_error"))
    light = totals.where(F.col("rows") * HEAVY <= n).select(F.col("label").alias("light"), F.col("label_error").alias("light_error"))
    near = coded.join(F.broadcast(heavy), F.col("label").eqNullSafe(F.col("heavy")), "left")
    done = near.where("heavy_error is not null").withColumn("label_error", F.col("heavy_error"))
    rest = near.where("heavy_error is null").join(light, F.col("label").eqNullSafe(F.col("light"))).withColumn("label_error", F.col("light_error"))
    return done.drop("heavy", "heavy_error").unionByName(rest.drop("heavy", "heavy_error", "light", "light_error"))


def codebooks_digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def restored(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """The rows with `vector`: the entries their codes stand for, as numbers of the given scale."""
    table = books / scale

    @F.pandas_udf("array<double>")
    def entries(codes):
        return codes.map(lambda c: np.concatenate([table[p, e] for p, e in enumerate(bytes.fromhex(c))]))

    return coded.withColumn("vector", entries("code"))
