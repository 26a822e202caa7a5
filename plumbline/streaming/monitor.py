"""The checks on streams: bursts, revisions, stale results, validation and order monitoring."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions.model import Model
from plumbline.functions.stepping import inside
from plumbline.plans.skew import skew_join


def event_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; zone-less times are read in the session's zone."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def debounce(df: DataFrame, keys: Sequence[str], ts: str, gap: str, value: Column | None = None, watermark: str | None = None) -> DataFrame:
    """One row per burst: an arrival inside the gap restarts it. Works on tables and streams; on a
    stream give a watermark, and a burst is emitted once the watermark has passed its end."""
    if watermark:
        df = df.withWatermark(ts, watermark)
    last = F.max_by(value if value is not None else F.col(ts), F.col(ts))
    out = df.groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("arrivals"), F.max(ts).alias("last_at"), last.alias("last_value"))
    return out.select(*keys, F.col("_w.start").alias("burst_start"), "last_at", "arrivals", "last_value")


def latest_revision(df: DataFrame, keys: Sequence[str], revision: str) -> DataFrame:
    """Newest revision of each document, as a whole row; of equal revisions the row with the largest other columns. An
    aggregate, so one row per document is kept as state and a stream runs it in update or complete mode."""
    cols = [c for c in df.columns if c not in (*keys, revision)]
    newest = df.groupBy(*keys).agg(F.max(F.struct(revision, *cols)).alias("_newest"))
    return newest.select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in (revision, *cols)])


def mark_stale(results: DataFrame, revisions: DataFrame, keys: Sequence[str], revision: str) -> DataFrame:
    """Results stay, flagged where a newer revision of their own document exists."""
    newest = revisions.groupBy(*keys).agg(F.max(revision).alias("_latest"))
    out = skew_join(results, newest, keys, "left")
    return out.withColumn("stale", F.coalesce(F.col(revision) < F.col("_latest"), F.lit(False))).drop("_latest")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint area; a local temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix=f"plumbline-{name}-")


def validate_stream(stream: DataFrame, check: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None):
    """Run a stateless check on each micro-batch and append its findings. A batch rewrites its own
    folder, so one that runs again after a failure leaves each finding once."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class GuardedCheck:
    """A check that can be replaced while a stream runs. While the new spec does not compile no new
    verdicts are given, and earlier ones stay, marked as coming from an older spec."""

    def __init__(self, compile_check: Callable[[dict], Callable[[DataFrame], DataFrame]]):
        self.compile_check, self.check, self.spec_version, self.error = compile_check, None, 0, None

    def update(self, spec: dict) -> bool:
        self.spec_version += 1
        try:
            self.check, self.error = self.compile_check(spec), None
        except Exception as bad:
            self.check, self.error = None, str(bad)
        return self.check is not None

    def __call__(self, batch: DataFrame) -> DataFrame:
        from plumbline.operators.findings import SCHEMA
        if self.check is None:
            found = batch.sparkSession.createDataFrame([], SCHEMA)
        else:
            found = self.check(batch)
        return found.withColumn("spec_version", F.lit(self.spec_version))


MONITOR_SCHEMA = "key string, at timestamp, symbol string, state int, status string"


class _Monitor(StatefulProcessor):
    """Per key: the model state (one INT) and nothing else; rows of a batch are taken in time order."""

    def __init__(self, model: Model, timeout_ms: int | None, order: str, symbol: str):
        self.steps, self.accepts, self.dead = model.steps, model.accepts, model.dead
        self.classes = {n: i for i, n in enumerate(model.names[:-1])}
        self.timeout_ms, self.order, self.symbol = timeout_ms, order, symbol

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType([T.StructField("s", T.IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get()[0] if self.state.exists() else 0
        broke = None
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for at, symbol in zip(batch[self.order], batch[self.symbol]):
            if state == self.dead:
                break
            state = self.steps.one(state, self.classes.get(symbol, len(self.classes)))
            if state == self.dead:
                broke = (str(key[0]), at, symbol, state, "violation")
        self.state.update((state,))
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state != self.dead:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield pd.DataFrame([broke] if broke else [], columns=["key", "at", "symbol", "state", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get()[0] if self.state.exists() else 0
        open_key = state != self.dead and not inside(self.accepts, state)
        out = [(str(key[0]), None, None, state, "incomplete")] if open_key else []
        yield pd.DataFrame(out, columns=["key", "at", "symbol", "state", "status"]).astype({"at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def sequence_monitor(stream: DataFrame, key: str, order: str, symbol: str, model: Model, timeout_ms: int | None = None) -> DataFrame:
    """First violation of each key as it happens; with a timeout, keys left incomplete are reported.

    Needs the RocksDB state store. A key's rows inside one micro-batch are sorted in its task, so
    bound the batch at the source (maxFilesPerTrigger or maxBytesPerTrigger).
    """
    processor = _Monitor(model, timeout_ms, order, symbol)
    return (stream.select(key, order, symbol).groupBy(key)
            .transformWithStateInPandas(statefulProcessor=processor, outputStructType=T.StructType.fromDDL(MONITOR_SCHEMA), outputMode="Update",
                                        timeMode="ProcessingTime" if timeout_ms is not None else "None"))


class _Waiting(StatefulProcessor):
    """Per key: the model state, the time of the last row taken, and the rows that wait for the watermark."""

    def __init__(self, model: Model, order: str, symbol: str):
        self.steps, self.dead, self.order, self.symbol = model.steps, model.dead, order, symbol
        self.classes = {n: i for i, n in enumerate(model.names[:-1])}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType().add("s", T.IntegerType()).add("taken", T.LongType()))
        self.waiting = handle.getListState("waiting", T.StructType().add("at", T.LongType()).add("symbol", T.StringType()))

    def now(self) -> tuple[int, int | None]:
        return tuple(self.state.get()) if self.state.exists() else (0, None)

    def out(self, rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["key", "at", "symbol", "state", "status"])
        made["at"] = pd.to_datetime(made["at"], unit="us")
        return made.astype({"state": "Int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, taken = self.now()
        if state == self.dead:
            for _ in rows:  # a key has one first violation; nothing waits after it
                pass
            yield self.out([])
            return
        held = list(self.handle.listTimers())
        first = min(held, default=None)
        for part in rows:
            keep, late = [], []
            for at, symbol in zip(part[self.order].tolist(), part[self.symbol]):
                if taken is not None and at < taken:
                    late.append((str(key[0]), at, symbol, state, "late"))
                else:
                    keep.append((at, symbol))
            if keep:
                self.waiting.appendList(keep)
                low = min(at for at, _ in keep) // 1000
                first = low if first is None else min(first, low)
            yield self.out(late)
        if first is not None and held != [first]:
            for timer in held:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, taken = self.now()
        limit = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: r[0])
        due = [r for r in rows if r[0] // 1000 < limit]
        rest = rows[len(due):]
        broke = []
        for at, symbol in due:
            state, taken = self.steps.one(state, self.classes.get(symbol, len(self.classes))), at
            if state == self.dead:
                broke, rest = [(str(key[0]), at, symbol, state, "violation")], []
                break
        self.state.update((state, taken))
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000)
        yield self.out(broke)

    def close(self) -> None:
        pass


def ordered_monitor(stream: DataFrame, key: str, order: str, symbol: str, model: Model, delay: str) -> DataFrame:
    """First violation of each key, with rows taken in event-time order whatever the order of their arrival.

    A row waits as state until the watermark (newest time seen, less `delay`) has passed it, so the state of a key is its
    rows of the last `delay`. A row older than one already taken cannot be put in order: it comes out with status late
    and is not judged. Rows after a key's violation are dropped; rows within `delay` of the newest time still wait when a stream
    ends; rows without a time are left out; rows of one key with equal times are taken in any order. Needs the RocksDB state store.
    """
    timed = stream.where(F.col(order).isNotNull()).withWatermark(order, delay)
    # a plain number has no watermark of its own, so Spark does not drop late rows before they are reported
    plain = timed.select(F.col(key), F.unix_micros(order).alias(order), F.col(symbol))
    return plain.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Waiting(model, order, symbol), outputStructType=T.StructType.fromDDL(MONITOR_SCHEMA), outputMode="Update", timeMode="EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now and read its result back from a table folder. In
    complete and update mode each batch replaces or adds its rows under its batch number."""
    spark = stream.sparkSession
    root = run_dir(spark, name)
    out = os.path.join(root, "out")
    writer = stream.writeStream.option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        def sink(batch: DataFrame, batch_id: int) -> None:
            target = out if mode == "complete" else f"{out}/batch={batch_id}"
            batch.write.mode("overwrite").parquet(target)
        query = writer.foreachBatch(sink).outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if mode != "update" else spark.read.parquet(out).drop("batch")


def spec_hash(spec: object) -> str:
    """Stable text identity of a spec."""
    import hashlib
    return hashlib.sha256(_plain(spec).encode()).hexdigest()


def _plain(x: object) -> str:
    """Text of a spec that does not depend on the order of sets and dicts."""
    import dataclasses
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return type(x).__name__ + _plain({f.name: getattr(x, f.name) for f in dataclasses.fields(x)})
    if isinstance(x, dict):
        return "{" + ",".join(sorted(f"{_plain(k)}:{_plain(v)}" for k, v in x.items())) + "}"
    if isinstance(x, (set, frozenset)):
        return "<" + ",".join(sorted(map(_plain, x))) + ">"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_plain, x)) + "]"
    return repr(x)


def recheck_on_spec_change(docs: DataFrame, key: Sequence[str], spec: object, verdicts: DataFrame | None) -> DataFrame:
    """Documents whose stored verdict is not for this text and this spec. Stored verdicts carry
    (key, doc_hash, spec_hash); new hashes are added to the returned rows."""
    cols = sorted(c for c in docs.columns if c not in key)
    hashed = docs.withColumn("doc_hash", F.xxhash64(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))).withColumn("spec_hash", F.lit(spec_hash(spec)))
    if verdicts is None:
        return hashed
    done = verdicts.select(*key, "doc_hash", "spec_hash").distinct()
    return hashed.join(done, [*key, "doc_hash", "spec_hash"], "left_anti")
