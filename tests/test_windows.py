"""Event time: a stream in shuffled files says what the table says; late rows are told apart alike."""

import os

from pyspark.sql import functions as F

from tamiz.streaming import windows


def files(df, path, n=3):
    """The rows of a table dealt to n files by their ids, each in no order, read as a stream of one file at a time."""
    spark = df.sparkSession
    for k in range(n):
        df.where(F.pmod(F.col("event_id") * 7, F.lit(n)) == k).orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
        for f in sorted(os.listdir(f"{path}/{k}")):
            if f.endswith(".parquet"):
                os.utime(f"{path}/{k}/{f}", (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def drain(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def events(spark, sf):
    end = F.lit("2030-01-01").cast("timestamp_ntz")
    found = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    # one event after all others, so that every window before it closes
    return found.unionByName(spark.createDataFrame([(-1, None, -1, "end", 0.0)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").withColumn("ts", end)).withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows_of_a_stream_are_those_of_the_table(spark, sf, tmp_path):
    df = events(spark, sf)
    # a delay longer than the events last: nothing is late, whatever the order of files
    for name, make in {
        "tumbling": lambda d: windows.windows(d, "6 hours", delay="40 days", total=F.round("value").cast("long")),
        "sliding": lambda d: windows.windows(d, "6 hours", "90 minutes", delay="40 days"),
        "spells": lambda d: windows.spells(d, "3 hours", delay="40 days"),
    }.items():
        got = drain(make(files(df, f"{tmp_path}/{name}")), name, tmp_path)
        assert rows(got.where("ends < '2029-01-01'")) == rows(make(df).where("ends < '2029-01-01'")), name


def test_repeats_within_the_delay_come_once(spark, sf, tmp_path):
    df = events(spark, sf)
    twice = df.unionByName(df.withColumn("ts", F.col("ts") + F.expr("interval 2 minutes")))
    got = drain(windows.once(files(twice, f"{tmp_path}/in"), delay="40 days"), "once", tmp_path)
    assert rows(got.select("event_id")) == rows(windows.once(twice).select("event_id")) == rows(df.select("event_id"))


def test_late_rows_are_kept_apart(spark, sf, tmp_path):
    df, seconds = events(spark, sf).where("event_id >= 0"), 86400.0 * 3
    arrived = df.withColumn("batch", F.pmod(F.col("event_id") * 7, F.lit(3)))
    # the first two files lack what the last one is late by
    arrived = arrived.where("batch = 2 or ts < '2024-01-20'")
    stream = files(arrived.drop("batch"), f"{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    for _ in range(2):  # from the start again: batches replace what they wrote
        q = stream.writeStream.foreachBatch(windows.write_by_time(out, seconds)).option("checkpointLocation", f"{tmp_path}/cp{_}").trigger(availableNow=True).start()
        q.awaitTermination()
    flagged = windows.late(arrived, seconds)
    for name, keep in (("on_time", "not late"), ("late", "late")):
        assert rows(spark.read.parquet(f"{out}/{name}").select("event_id", "ts")) == rows(flagged.where(keep).select("event_id", "ts"))
    counts = windows.late_counts(flagged).agg(F.sum("on_time"), F.sum("late")).first()
    assert 0 < counts[1] < counts[0] and sum(counts) == arrived.count()


def test_no_time_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "a", 1), (2, None, "a", 2)], "event_id long, ts timestamp, event_type string, batch int")
    assert windows.windows(df, "1 hour").count() == 0
    assert [tuple(r) for r in windows.late_counts(windows.late(df, 5)).collect()] == [("a", 2, 0)]
    assert windows.late(df.limit(0), 5).count() == 0
