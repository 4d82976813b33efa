"""The versioned store, files, and streams that must say what the batch form says."""

import random
import statistics
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamiz.operators import dialog, metrics
from tamiz.sources import files
from tamiz.sources import store as lookups
from tamiz.streaming import calls


def test_uploads(spark, tmp_path):
    for name, body in {"a.md": b"# x", "b.exe": b"1", "c.txt": b"", "sub/d?.txt": b"# x", "guía.pdf": b"%PDF", "notas (año 2).md": b"x", "k" * 130 + ".txt": b"y"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body)
    got = {r.file: (r.problem, r.text) for r in files.uploads(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.md": (None, "# x"), "b.exe": ("kind", None), "d_.txt": (None, "# x"), "c.txt": ("empty", None), "guía.pdf": (None, None), "notas (año 2).md": (None, "x"), "k" * 120: ("kind", None)}
    counts = {r.problem: (r.files, r.bytes) for r in files.upload_counts(files.uploads(spark, f"file://{tmp_path}")).collect()}
    assert counts == {"taken": (4, 11), "kind": (2, 2), "empty": (1, 0)}
    found = files.uploads(spark, f"file://{tmp_path}").where("problem is null")
    assert files.new_documents(found, found.limit(0)).count() == 3


def test_turn_log(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"call_id": "a", "t_tts_first_audio": 2.5, "tokens_in": 5}\n\n{"call_id": "a", "other": 1}\n')
    got = files.turn_log(spark, f"file://{tmp_path}/t.jsonl").where("call_id is not null")
    assert got.count() == 2
    r = metrics.call_rollup(got).first()
    assert (r.turns, r.calls, r.tokens_in_per_turn, r.tokens_per_call) == (2, 1, 2.5, 5.0)


def test_nearest_rank_and_median(spark):
    r = random.Random(1)
    groups = {"a": [r.randint(0, 9) for _ in range(37)], "b": [1e9, *[r.gauss(0, 1) for _ in range(500)]], "c": [5.0], "d": [2.0] * 40, "e": [1.0, 2.0]}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("g", None)], "k string, v double")
    ranked, median = ({x.k: x[1] for x in got.collect()} for got in (metrics.ranked(df, "v", 0.95, "k"), metrics.median(df, "v", "k")))
    for k, x in groups.items():
        assert ranked[k] == sorted(x)[min(len(x) - 1, round(0.95 * (len(x) - 1)))] and median[k] == statistics.median(x)
    assert set(ranked) == set(median) == set(groups)


def test_percentiles_under_skew(spark, monkeypatch):
    """One outlier far off, one value in most rows: no range that a task puts in order is large."""
    monkeypatch.setattr(metrics, "MOST", 50)
    monkeypatch.setattr(metrics, "RANGES", 8)
    r = random.Random(7)
    groups = {"out": [1e300, *[r.random() for _ in range(3000)]], "same": [1.0] * 2500 + [r.random() for _ in range(300)], "few": [3.0, 1.0], "steep": [10.0 ** r.uniform(-300, 300) for _ in range(2000)]}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x], "k string, v double").repartition(3)
    got = {x.k: (x["median"], x["ranked"]) for x in metrics.percentiles(df, "v", 0.95, "k").collect()}
    assert got == {k: (statistics.median(x), sorted(x)[min(len(x) - 1, round(0.95 * (len(x) - 1)))]) for k, x in groups.items()}


def test_lookups(spark, tmp_path):
    docs = spark.createDataFrame([("a", "One"), ("b", None)], "doc_id string, title string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    assert {(r.doc_id, r.there) for r in lookups.known(docs, ids).collect()} == {("a", True), ("b", True), ("c", False)}
    assert {(r.doc_id, r.title) for r in lookups.titled(ids, docs).collect()} == {("a", "One"), ("b", "b"), ("c", "c")}
    assert lookups.by_ids(docs, ids.limit(0), "doc_id").count() == 0
    (tmp_path / "v.txt").write_text("uno\ndos\n\n")
    assert files.vocabulary(spark, f"file://{tmp_path}/v.txt") == {"uno", "dos"} and files.vocabulary(spark, f"file://{tmp_path}/none") == frozenset()
    files.append_log(docs, f"file://{tmp_path}/log"), files.append_log(docs, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 4


def stream(spark, tmp_path, df, name):
    path = f"{tmp_path}/{name}"
    df.repartition(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(df, name, spark, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_levels_as_stream(spark, tmp_path):
    r = random.Random(2)
    turns = spark.createDataFrame([(f"c{c}", t, r.randint(0, 2)) for c in range(6) for t in range(8)], "call_id string, turn int, severity int")
    got = drain(calls.levels(stream(spark, tmp_path, turns, "turns")), "levels", spark, tmp_path)
    want = turns.selectExpr("call_id", "turn", "severity", "max(severity) over (partition by call_id order by turn) as call_severity")
    assert sorted(got.drop("raised").collect()) == sorted(want.collect())
    first = turns.selectExpr("call_id", "turn", "max(severity) over (partition by call_id order by turn) as m").groupBy("call_id", "m").agg(F.min("turn").alias("turn")).where("m > 0")
    assert sorted(tuple(x) for x in got.where("raised").select("call_id", "turn").collect()) == sorted((x.call_id, x.turn) for x in first.collect())


def test_utterances(spark, tmp_path):
    def frames(*spans):
        return [("c", ms, 0.9 if any(a <= ms < b for a, b in spans) else 0.05) for ms in range(0, 6400, 32)]

    rows = frames((320, 1600), (2000, 2592), (4000, 4480))
    df = spark.createDataFrame(rows, "call_id string, ms long, p double")
    got = drain(calls.utterances(stream(spark, tmp_path, df, "frames"), 800), "spoken", spark, tmp_path).orderBy("started_ms").collect()
    assert [(r.started_ms, r.cause) for r in got] == [(320, "silence"), (4000, "silence")]
    assert [r.sound_from_ms for r in got] == [0, 4000 - 19 * 32]
    # fed in two parts, or shuffled, the same comes out
    state, out = (-1, -1, -1), []
    for part in (rows[:70], rows[70:]):
        state, more = calls._utterances(state, pd.DataFrame(part, columns=["call_id", "ms", "p"]), 800, 30_000)
        out += more
    assert [tuple(o) for o in out] == [tuple(r)[1:] for r in got]


def brute_utterances(p, silence, longest=30_000):
    """Counts frames, as a listener does."""
    out, start, quiet, kept = [], None, 0, []
    for k, x in enumerate(p):
        if start is None:
            kept = [*kept, k][-20:]
            if x >= 0.35:
                start, quiet = k, 0
            continue
        if (k - start) * 32 >= longest:
            out.append((start, "length", kept[0]))
        elif x < 0.20:
            quiet += 1
            if quiet * 32 < silence:
                continue
            out.append((start, "silence", kept[0]))
        else:
            quiet = 0
            continue
        start, kept = None, []
    return out


@pytest.mark.parametrize(("silence", "brief"), [(800, False), (500, True)])
def test_utterances_by_counting_frames(silence, brief):
    r = random.Random(silence)
    for _ in range(60):
        p = [x for _ in range(r.randint(1, 12)) for x in [r.choice([0.05, 0.1, 0.3, 0.5, 0.9])] * r.choice([1, 2, 15, 16, 24, 25, 26, 300, 1000])]
        rows = pd.DataFrame({"ms": [32 * k for k in range(len(p))], "p": p, "brief": brief})
        _, got = calls._utterances((-1, -1, -1), rows)
        assert [(a // 32, cause, f // 32) for a, _, cause, f in got] == brute_utterances(p, silence)


def test_chunks_of_a_key_are_put_in_order():
    parts = [pd.DataFrame({"turn": [5, 3]}), pd.DataFrame({"turn": [4, 1]})]
    assert calls.ordered(iter(parts), "turn")["turn"].tolist() == [1, 3, 4, 5]


def test_guards_as_a_stream_say_what_the_window_says(spark, tmp_path):
    lines = [("¿Cómo ha estado el dolor?", "en seis"), ("¿Cuál es su temperatura?", "mm"), ("¿Cuál es su temperatura?", "mm"), ("¿Cuál es su temperatura?", "no he tenido fiebre"), ("¿Cómo está la herida?", "me sale pus"), ("¿Le quedó claro?", "sí"), ("¿Algo más?", "¿puedo caminar?"), ("¿Algo más?", "no gracias")]
    turns = spark.createDataFrame([(f"c{c}", i, q, a) for c in range(3) for i, (q, a) in enumerate(lines[c:])], "call_id string, turn int, question string, text string")
    # with a timer of processing time batches never end by themselves
    q = calls.guarded(stream(spark, tmp_path, turns, "answers")).writeStream.format("memory").queryName("guarded").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    for _ in range(60):
        if q.exception() or spark.table("guarded").where("action <> 'nudge'").count() >= turns.count():
            break
        time.sleep(1)
    q.stop()
    got = spark.table("guarded")
    said = turns.selectExpr("call_id", "turn * 2 as turn", "'assistant' as role", "question as text").unionByName(turns.selectExpr("call_id", "turn * 2 + 1 as turn", "'user' as role", "text"))
    want = dialog.processed(said).selectExpr("call_id", "cast((turn - 1) / 2 as int) as turn", "action", "next_item", "unclear")
    assert sorted(map(tuple, got.where("action <> 'nudge'").collect())) == sorted(map(tuple, want.collect()))
    assert {r.action for r in want.collect()} == {"slot", "repeat", "escalate", "confirmation", "answer", "farewell"}


def test_three_strikes_call_people():
    rows = pd.DataFrame([{"turn": i, "confirmed": False, "farewell": False, "thanks": False, "alarm": None, "status": s, "question": False, "slot": "dolor", "known": []} for i, s in enumerate(["unclear", "unclear", "unclear", "filled", "unclear"])])
    out, *_ = calls._guarded(rows, False, set(), 0)
    assert [x[1] for x in out] == ["repeat", "repeat", "call_people", "slot", "repeat"]


def test_alerts_are_written_once(spark, tmp_path):
    sink = calls.write_alerts(f"file://{tmp_path}/alerts")
    rows = [("a", "fever", True), ("a", "fever", True), ("a", "pain", True), ("b", "fever", False)]
    batch = spark.createDataFrame(rows, "call_id string, reason string, raised boolean")
    more = spark.createDataFrame([("a", "fever", True), ("b", "pain", True)], batch.schema)
    sink(batch, 0), sink(batch, 0), sink(more, 1), sink(batch, 0), sink(more, 1)
    assert sorted((r.call_id, r.reason) for r in spark.read.json(f"file://{tmp_path}/alerts").collect()) == [("a", "fever"), ("a", "pain"), ("b", "pain")]
