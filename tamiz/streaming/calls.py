"""Calls as keyed streams: running state and level, voice sessions, guards with idle timers, and alerts written once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tamiz.operators import dialog

#: Voice starts at this probability, pauses under the other, and ends after so many quiet ms, or fewer where a short answer
#: is awaited; longest utterance, length of a frame in ms; frames kept from before the start.
START, QUIET, SILENCE_MS, SHORT_MS, LONGEST_MS, FRAME_MS, BEFORE = 0.35, 0.20, 800, 500, 30_000, 32, 20
#: Unclear answers in a row after which people are called in.
STRIKES = 3
#: Idle seconds before a nudge, and nudges at most.
IDLE_S, NUDGES = 20, 3


def sessions(events: DataFrame, gap_seconds: float, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, session, started, ended, n): events of a key with no gap of more than gap_seconds; one shuffle."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    new = F.when(seconds - F.lag(seconds).over(w) <= gap_seconds, 0).otherwise(1)
    marked = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def nudges(events: DataFrame, idle_seconds: float = IDLE_S, most: int = NUDGES, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, event_id, nudges): how often silence after an event was broken, once per idle_seconds, up to `most`."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    idle = F.lead(seconds).over(w) - seconds
    return events.select(key, "event_id", F.least(F.lit(most), F.floor(idle / idle_seconds)).cast("int").alias("nudges")).where("nudges > 0")


def ordered(chunks: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """All rows of a key in a micro-batch in their order: Spark hands them over in several chunks."""
    return pd.concat(list(chunks), ignore_index=True).sort_values(by, kind="stable")


def _utterances(state: tuple, rows: pd.DataFrame, silence: int = SILENCE_MS, longest: int = LONGEST_MS) -> tuple[tuple, list[tuple]]:
    """Hysteresis over (ms, p[, brief]) rows in order; state is (start, quiet since, first frame since the last utterance),
    each -1 where there is none. An utterance is (start, end, cause, where its sound begins)."""
    start, quiet, first = state
    brief = rows["brief"].fillna(False).tolist() if "brief" in rows else [False] * len(rows)
    out = []
    for ms, p, short in zip(rows["ms"].tolist(), rows["p"].tolist(), brief, strict=True):
        first = ms if first < 0 else first
        if start < 0:
            if p >= START:
                start, quiet = ms, -1
            continue
        quiet = -1 if p >= QUIET else (ms if quiet < 0 else quiet)
        end = (ms, "length") if ms - start >= longest else (quiet, "silence") if quiet >= 0 and ms - quiet + FRAME_MS >= (SHORT_MS if short else silence) else None
        if end:
            out.append((start, *end, max(first, start - (BEFORE - 1) * FRAME_MS)))
            start = quiet = first = -1
    return (start, quiet, first), out


def utterances(frames: DataFrame, silence: int = SILENCE_MS, longest: int = LONGEST_MS) -> DataFrame:
    """(call_id, started_ms, ended_ms, cause, sound_from_ms) of a stream or a table of frames (call_id, ms, p), by keyed state.

    A column `brief` says at which frames a short answer is awaited.
    """
    names = ["call_id", "started_ms", "ended_ms", "cause", "sound_from_ms"]

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, found = _utterances(state.get if state.exists else (-1, -1, -1), ordered(chunks, "ms"), silence, longest)
        state.update(tuple(map(int, now)))
        yield pd.DataFrame([(key[0], *f) for f in found], columns=names)

    return frames.groupBy("call_id").applyInPandasWithState(step, "call_id string, started_ms long, ended_ms long, cause string, sound_from_ms long", "start long, quiet long, first long", "append", GroupStateTimeout.NoTimeout)


def levels(turns: DataFrame) -> DataFrame:
    """(call_id, turn, severity, call_severity, raised) of a stream of evaluated turns; severity never falls in a call."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (worst,) = state.get if state.exists else (0,)
        rows = ordered(chunks, "turn")
        running = rows["severity"].cummax().clip(lower=worst)
        raised = running > running.shift(fill_value=worst)
        state.update((int(running.iloc[-1]) if len(running) else worst,))
        yield rows.assign(call_severity=running, raised=raised)[["call_id", "turn", "severity", "call_severity", "raised"]]

    return turns.select(F.col("call_id").cast("string").alias("call_id"), "turn", "severity").groupBy("call_id").applyInPandasWithState(step, "call_id string, turn int, severity int, call_severity int, raised boolean", "worst int", "append", GroupStateTimeout.NoTimeout)


def _guarded(rows: pd.DataFrame, alerted: bool, done: set[str], unclear: int) -> tuple[list[tuple], bool, set[str], int]:
    """(turn, action, next item, unclear answers in a row) of each of a call's turns, and the state after them."""
    out = []
    for r in rows.to_dict("records"):
        if alerted and r["confirmed"]:
            action = "confirmation"
        elif r["farewell"] or (alerted and r["thanks"]):
            action = "farewell"
        elif r["alarm"] is not None and not alerted:
            action = "escalate"
        else:
            action = {"filled": "slot", "unclear": "repeat"}.get(r["status"], "answer" if r["question"] else "extract")
        unclear = unclear + 1 if action == "repeat" else 0
        alerted |= action == "escalate"
        done |= set(r["known"]) | ({r["slot"]} if action == "slot" else set())
        out.append((r["turn"], "call_people" if unclear == STRIKES else action, next((k for k in dialog.CHECKLIST if k not in done), None), unclear))
    return out, alerted, done, unclear


def guarded(turns: DataFrame, idle_seconds: float = IDLE_S, most: int = NUDGES) -> DataFrame:
    """(call_id, turn, action, next_item, unclear) of a stream of answers (call_id, turn, question, text), by keyed state.

    What a turn says is told by columns; the state of a call is whether an alert went out, what is known, how many
    answers in a row were unclear, and how often silence was broken. A call that is silent for idle_seconds gets a row
    with action `nudge` (turn null), up to `most` times until it speaks again.
    """
    names, wait = ["call_id", "turn", "action", "next_item", "unclear"], int(idle_seconds * 1000)

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alerted, done, unclear, nudged = state.get if state.exists else (False, [], 0, 0)
        if state.hasTimedOut:
            nudged += 1
            out = [(None, "nudge", None, unclear)]
        else:
            out, alerted, done, unclear = _guarded(ordered(chunks, "turn"), alerted, set(done), unclear)
            nudged = 0
        state.update((bool(alerted), sorted(done), int(unclear), int(nudged)))
        if nudged < most:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=names)

    said = dialog.told(turns.select(F.col("call_id").cast("string").alias("call_id"), "turn", "question", "text"))
    return said.groupBy("call_id").applyInPandasWithState(step, "call_id string, turn int, action string, next_item string, unclear int", "alerted boolean, done array<string>, unclear int, nudged int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_alerts(path: str, keys: tuple[str, ...] = ("call_id", "reason")):
    """A foreachBatch sink that writes an alert once for each call and reason.

    A batch has a folder of its own, so that one that is run again replaces what it wrote; what other batches have
    written is left out.
    """

    def sink(batch: DataFrame, number: int) -> None:
        new = batch.where("raised").dropDuplicates(list(keys))
        spark, folder = batch.sparkSession, f"{path}/batch={number}"
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*"))
        others = [p.getPath().toString() for p in found or [] if p.getPath().getName() != f"batch={number}"]
        if others:
            new = new.join(spark.read.schema(batch.schema).json(others).select(*keys).distinct(), list(keys), "left_anti")
        new.write.mode("overwrite").json(folder)

    return sink
