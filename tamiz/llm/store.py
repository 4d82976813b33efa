"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two longs that one broadcast may hold (about 64 MB); larger sides are joined by a shuffle.
BROADCAST_ROWS = 4_000_000
#: Bytes of a batch that goes to Python at most; rows that a Parquet reader holds at once.
LEAN = {"spark.sql.execution.arrow.maxBytesPerBatch": "4000000", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of our own only where it is unset and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tamiz-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def lean(df: DataFrame) -> SparkSession:
    """The session of df, with settings for rows that are whole texts where it has none of its own: Spark's defaults read
    4096 of them at once and hand 10,000 to Python, held by the executor and by its Python worker."""
    spark = df.sparkSession
    for name, value in LEAN.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


def lent(df: DataFrame, value: Broadcast) -> DataFrame:
    """df, which reads a broadcast value when it runs."""
    df._tamiz_lent = value
    return df


def returned(df: DataFrame) -> None:
    """Frees the value lent to df on all executors, once nothing runs df any more."""
    df._tamiz_lent.destroy()


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, so a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tamiz_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table made by saved() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tamiz_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are few enough, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df
