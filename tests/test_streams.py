"""The event-time monitor on rows that arrive out of order."""

import time

from plumbline.functions.model import compile_model, elem, seq
from plumbline.streaming import monitor as M


def run(spark, tmp_path, batches, delay="5 seconds"):
    """Batches as files, one a trigger; a last row far ahead moves the watermark past everything."""
    src = tmp_path / "in"
    for i, batch in enumerate(batches + [[("end", 10_000.0, "open")]]):
        spark.createDataFrame(batch, "k string, t double, s string").selectExpr("k", "cast(t as timestamp) as ts", "s").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.05)
    stream = spark.readStream.schema("k string, ts timestamp, s string").option("maxFilesPerTrigger", 1).parquet(str(src))
    model = compile_model(seq(elem("open"), elem("work", 0, None), elem("close")))
    out = M.drain(M.ordered_monitor(stream, "k", "ts", "s", model, delay), "ordered", "update")
    return sorted((r["key"], r["at"].timestamp(), r["symbol"], r["status"]) for r in out.collect())


def test_rows_late_within_the_delay_are_taken_in_order(spark, tmp_path):
    batches = [[("a", 103.0, "close"), ("b", 102.0, "work"), ("c", 101.0, "close")],
               [("a", 102.0, "work"), ("b", 101.0, "open"), ("c", 100.0, "open")],
               [("a", 101.0, "open"), ("b", 103.0, "open"), ("b", 104.0, "open")]]
    assert run(spark, tmp_path, batches) == [("b", 103.0, "open", "violation")]


def test_rows_older_than_those_taken_come_out_as_late(spark, tmp_path):
    batches = [[("a", 100.0, "open"), ("a", 102.0, "work")], [("b", 200.0, "open")], [("c", 201.0, "open")],
               [("a", 101.0, "close"), ("a", 102.0, "work"), ("a", 103.5, "close"), ("n", 202.0, None)]]
    assert run(spark, tmp_path, batches) == [("a", 101.0, "close", "late"), ("n", 202.0, None, "violation")]


def test_rows_without_a_time_are_left_out(spark, tmp_path):
    assert run(spark, tmp_path, [[("a", None, "close"), ("a", 100.0, "open"), ("a", 101.0, "close")]]) == []
