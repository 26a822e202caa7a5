"""Streaming operators, run over a file stream of the events table and compared with batch SQL."""

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.functions import types as Y
from plumbline.functions.model import choice, compile_model, elem, seq
from plumbline.operators import check as C
from plumbline.streaming import monitor as M


def stream(spark, sf, name="events"):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(sf)


BURSTS = """
with g as (select user_id, ts, props, event_id, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
b as (select *, sum(new) over (partition by user_id order by ts) as burst from g)
select user_id, epoch_us(min(ts)) as started, epoch_us(max(ts)) as ended, count(*) as arrivals, arg_max(props, ts) as last_value from b group by user_id, burst"""


@query("V1_debounce", BURSTS)
def debounce(spark, sf):
    """Complete mode, so bursts still open at the watermark are included."""
    events = M.event_time(stream(spark, sf), "ts")
    out = M.drain(M.debounce(events, ["user_id"], "ts", "30 minutes", F.col("props"), "1 hour"), "debounce", "complete")
    return out.select("user_id", F.unix_micros("burst_start").alias("started"), F.unix_micros("last_at").alias("ended"), "arrivals", "last_value")


@query("V2_latest_revision", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def latest(spark, sf):
    docs = stream(spark, sf).select("user_id", "event_id", "event_type", "value")
    return M.drain(M.latest_revision(docs, ["user_id"], "event_id"), "latest", "complete")


@query("V3_mark_stale", "select event_id, user_id, event_id < max(event_id) over (partition by user_id) as stale from events")
def stale(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    return M.mark_stale(events, events, ["user_id"], "event_id")


@query("V4_validate_stream", """
select cast(event_id as varchar) as row_key, 'cvc-enumeration-valid' as code, cast(1 as integer) as spec_version from events where event_type not in ('click', 'view', 'signup')
union all select cast(event_id as varchar), 'cvc-range-valid', 1 from events where value > 100""")
def validate(spark, sf):
    def build(spec):
        kinds, top = Y.builtin("string", enumeration=spec["kinds"]), Y.builtin("double", max_inclusive=spec["top"])
        return lambda batch: C.check_table(batch, {"event_type": kinds, "value": top}, ["event_id"])
    check = M.GuardedCheck(build)
    check.update({"kinds": ["click", "view", "signup"], "top": "100"})
    root = M.run_dir(spark, "validate")
    M.validate_stream(stream(spark, sf), check, f"{root}/findings", f"{root}/ckpt").awaitTermination()
    return spark.read.parquet(f"{root}/findings").select("row_key", "code", "spec_version")


def signup_model():
    """No purchase directly after a signup."""
    plain = [elem("view"), elem("click"), elem("error")]
    return compile_model(seq(choice(*plain, elem("purchase"), seq(elem("signup", 1, None), choice(*plain)), lo=0, hi=None), elem("signup", 0, None)))


@query("V5_sequence_monitor", """
with w as (select user_id, ts, event_type, lag(event_type) over (partition by user_id order by ts) as p from events)
select cast(user_id as varchar) as key, min(epoch_us(ts)) as at, 'violation' as status from w where p = 'signup' and event_type = 'purchase' group by user_id""")
def monitor(spark, sf):
    """First purchase directly after a signup, per user."""
    model = signup_model()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", M.ROCKSDB)
    events = M.event_time(stream(spark, sf), "ts")
    out = M.drain(M.sequence_monitor(events, "user_id", "ts", "event_type", model), "monitor", "update")
    return out.select("key", F.unix_micros("at").alias("at"), "status")


@query("V5b_ordered_monitor", """
with e as (select *, (select epoch_ms(max(ts)) from events) - 86400000 as passed from events),
w as (select user_id, ts, passed, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as p from e)
select cast(user_id as varchar) as key, min(epoch_us(ts)) as at, 'violation' as status from w
where p = 'signup' and event_type = 'purchase' and epoch_ms(ts) < passed group by user_id""")
def ordered(spark, sf):
    """The same where rows arrive up to a day late, in four files: only what the watermark has passed is judged."""
    events = table(spark, sf, "events")
    late = F.expr("unix_micros(cast(ts as timestamp)) + pmod(xxhash64(event_id), 86400) * 1000000")
    arrival = events.withColumn("_arrival", late)
    spread = arrival.agg(F.min("_arrival").alias("_low"), F.max("_arrival").alias("_high"))
    part = F.floor((F.col("_arrival") - F.col("_low")) * 4 / (F.col("_high") - F.col("_low") + 1)).cast("int")
    root = M.run_dir(spark, "dealt")
    dealt = arrival.join(F.broadcast(spread), how="cross").withColumn("part", part).drop("_arrival", "_low", "_high")  # one row of bounds
    for i in range(4):
        dealt.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", M.ROCKSDB)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = M.drain(M.ordered_monitor(M.event_time(source, "ts"), "user_id", "ts", "event_type", signup_model(), "1 day"), "ordered", "update")
    return out.select("key", F.unix_micros("at").alias("at"), "status")


@query("V6_recheck_on_spec_change", """
select doc_id, 'document' as cause from documents where doc_id % 10 = 0 union all select doc_id, 'spec' from documents""")
def recheck(spark, sf):
    docs = table(spark, sf, "documents")
    stored = M.recheck_on_spec_change(docs, ["doc_id"], {"v": 1}, None)
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    changed = M.recheck_on_spec_change(edited, ["doc_id"], {"v": 1}, stored).select("doc_id", F.lit("document").alias("cause"))
    return changed.unionByName(M.recheck_on_spec_change(docs, ["doc_id"], {"v": 2}, stored).select("doc_id", F.lit("spec").alias("cause")))
