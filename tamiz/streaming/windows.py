"""Event time: windows behind a watermark, duplicates within it, and late rows told apart and kept.

All functions take a stream or a table: on a table the watermark has no effect, so the batch form says what a stream says once
all its windows are closed and nothing came late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far behind the latest event a row may come.
DELAY = "10 minutes"


def windows(events: DataFrame, length: str, slide: str | None = None, delay: str = DELAY, by: tuple[str, ...] = ("event_type",), ts: str = "ts", **sums: Column) -> DataFrame:
    """(by.., starts, ends, n, sums..) of tumbling windows, or of sliding ones where `slide` is shorter than `length`.

    A stream gives a window once the watermark has passed its end, and then forgets it; rows of windows that are closed are
    left out (late() keeps them). Rows without a time are in no window.
    """
    rows = events.withWatermark(ts, delay)
    counted = rows.groupBy(F.window(ts, length, slide), *by).agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))
    return counted.select(*by, F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), "n", *sums)


def spells(events: DataFrame, gap: str, delay: str = DELAY, by: tuple[str, ...] = ("user_id",), ts: str = "ts") -> DataFrame:
    """(by.., starts, ends, n): sessions that end when nothing has come for `gap`."""
    counted = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return counted.select(*by, F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), "n")


def once(events: DataFrame, keys: tuple[str, ...] = ("event_id",), delay: str = DELAY, ts: str = "ts") -> DataFrame:
    """One row of each key. A stream remembers a key until the watermark has passed its first row by `delay`, so repeats that come
    within it are dropped and the state stays as small as a delay's keys."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def _before(ts: str, seconds: float) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - seconds


def late(arrived: DataFrame, seconds: float, batch: str = "batch", ts: str = "ts") -> DataFrame:
    """arrived with `late`: whether a row is more than `seconds` behind the latest time of all earlier batches; rows of the first
    batch and rows without a time are not. The batches, not the rows, go through one window."""
    w = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    marks = arrived.groupBy(batch).agg(F.max(_before(ts, seconds)).alias("high")).withColumn("mark", F.max("high").over(w)).select(batch, "mark")
    return arrived.join(F.broadcast(marks), batch).withColumn("late", F.coalesce(_before(ts, 0) < F.col("mark"), F.lit(False))).drop("mark")


def late_counts(flagged: DataFrame, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(by.., on_time, late): rows of each kind."""
    return flagged.groupBy(*by).agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))


def write_by_time(path: str, seconds: float, ts: str = "ts"):
    """A foreachBatch sink that writes a batch's rows on time and its late ones apart: path/on_time, path/late.

    Late is what late() says with micro-batches as batches. The highest time so far is a small file of its own for each
    batch, so a batch that is run again is judged by the batches before it and replaces what it wrote.
    """

    def sink(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/seen")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [p.getPath().getName() for p in (fs.listStatus(root) if fs.exists(root) else [])]
        earlier = [int(n.split("=")[1]) for n in found if n.startswith("batch=") and int(n.split("=")[1]) < number]
        mark = spark.read.schema("high double").json(f"{path}/seen/batch={max(earlier)}").first()[0] if earlier else None
        rows.persist()
        high = rows.agg(F.max(_before(ts, 0))).first()[0]
        is_late = F.coalesce(_before(ts, -seconds) < F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        rows.where(~is_late).write.mode("overwrite").parquet(f"{path}/on_time/batch={number}")
        rows.where(is_late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        highest = max((x for x in (mark, high) if x is not None), default=None)
        spark.createDataFrame([(highest,)], "high double").coalesce(1).write.mode("overwrite").json(f"{path}/seen/batch={number}")
        rows.unpersist()

    return sink
