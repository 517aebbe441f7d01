"""Structured Streaming over the event log: an extension, the batch forms of which are in operators.tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream of files, with event time as a timestamp.

    path: a folder, or one file, which a stream source takes only as a pattern.
    """
    return spark.readStream.schema(EVENTS).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("at", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events by day and type; what comes later than the watermark is dropped."""
    by = events.withWatermark("at", late).groupBy(F.window("at", size), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def streaks(events: DataFrame, least: int = 3) -> DataFrame:
    """user_id and streak whenever a user's run of errors reaches least; a run ends with any other event."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = []
        for f in frames:
            for kind in f.sort_values(["ts", "event_id"])["event_type"]:
                run = run + 1 if kind == "error" else 0
                if run == least:
                    rows.append((key[0], run))
        state.update((run,))
        yield pd.DataFrame(rows, columns=["user_id", "streak"])

    own = events.select("user_id", "event_id", "ts", "event_type")
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id long, streak int", "run int", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that has arrived, as a table in memory of that name."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame) -> DataFrame:
    """All rows that an appending stream has made of what has arrived, as a table in the folder that spark.checkpoint.dir names; it goes when the driver ends.

    Where that is unset, a folder of our own if all is on one machine, else an error.
    """
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="loomgrid-stream-")
    at = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
