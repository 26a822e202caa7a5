"""Cutting lineage in loops: rounds are written to the session's shared checkpoint folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Plain pages, so that the size of the files is that of the rows and Spark broadcasts by it what it may.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df` as a table of their own. A checkpoint would keep the size that the plan was estimated at; in a loop of joins
    the digits of that product double with every round, until the driver has no room for the number."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-ckpt-"))
    path = f"{(folder or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.options(**PLAIN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
