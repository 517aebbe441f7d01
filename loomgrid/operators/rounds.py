"""Work in rounds: cutting lineage between them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> None:
    """Sets the folder that spark.checkpoint.dir names; where it is unset, only a session on one machine gets one of its own."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="loomgrid-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, read back from that folder."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read back from a compressed table in that folder, in any partitions; it goes when the driver ends."""
    _folder(df)
    spark = df.sparkSession
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)
