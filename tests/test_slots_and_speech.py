"""Slots, grounding, repair and signal on hand-written cases."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.operators import grounding, guards, records, rules, slots, speech_repair
from tamiz.streaming import signal


def one(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("slot", "text", "status", "got"),
    [
        ("dolor", "el dolor está en seis", "filled", {"pain": 6.0}), ("dolor", "sais", "filled", {"pain": 6.0}), ("dolor", "mm", "unclear", {}), ("dolor", "una pregunta, doctora", "open", {}),
        ("fiebre", "treinta y ocho punto cinco", "filled", {"fever": 38.5}), ("fiebre", "no he tenido fiebre", "filled", {"no_fever": True}), ("fiebre", "no sé", "unclear", {}),
        ("herida", "sin secreción, un poco roja", "filled", {"wound": "enrojecida"}), ("herida", "se ve normal", "filled", {"wound": "normal"}), ("herida", "le sale pus", "open", {}), ("herida", "no sé decirle", "open", {}),
        ("apetito_sueno", "no tengo apetito", "filled", {"appetite": "nulo"}), ("movilidad", "camino bien", "filled", {}), ("cita", "el lunes", "open", {}), (None, "hola", "open", {}), ("dolor", "", "unclear", {}),
    ],
)
def test_slots(spark, slot, text, status, got):
    row = one(spark, slots.parsed(F.col("s"), F.col("t")), s=slot, t=text).asDict()
    assert row.pop("status") == status
    assert {k: v for k, v in row.items() if v is not None} == got


@pytest.mark.parametrize(("text", "want"), [("tengo 36 grados y seis de dolor", 6), ("el dolor en cuatro o tres no", 3), ("once", None), ("ocho", 8), ("nuebe", 9), ("cuattro", 4), ("siette", 7), ("hola", None), (None, None)])
def test_spoken_number(spark, text, want):
    assert one(spark, slots.spoken_number(F.col("t")), t=text) == want


def test_questions_and_replies(spark):
    assert one(spark, slots.asked(F.col("t")), t="¿Cómo le va al moverse o caminar?") == "movilidad"
    assert one(spark, slots.asked(F.col("t")), t="hola") is None
    got = slots.parsed(F.lit("fiebre"), F.col("t"))
    assert one(spark, slots.acknowledged(F.lit("fiebre"), got), t="treinta y ocho") == "De acuerdo, 38 grados."
    assert one(spark, slots.acknowledged(F.lit("fiebre"), got), t="nada de fiebre") == "De acuerdo, sin fiebre."
    assert one(spark, slots.confirmed(F.col("t"), F.lit("¿Le quedó claro?")), t="no me quedó claro") == "No, no me quedó claro."
    assert one(spark, slots.confirmed(F.col("t"), F.lit("¿Le quedó claro?")), t="y se quede a un lado") == "Sí, quedó claro."
    assert one(spark, slots.confirmed(F.col("t"), F.lit("hola")), t="sí") is None
    assert one(spark, slots.farewell(F.col("t"), F.lit(None).cast("string"), F.lit(False)), t="No gracias.") is True
    assert one(spark, slots.farewell(F.col("t"), F.lit("dolor"), F.lit(False)), t="no") is False


def test_grounding(spark):
    claims = {"pain": F.lit(2.0), "fever": F.lit(40.0), "wound": F.lit("normal"), "appetite": F.lit("nulo"), "sleep": F.lit("alterado"), **{n: F.lit(True) for n in rules.FLAGS}}

    def of(text):
        row = one(spark, F.struct(*(c.alias(n) for n, c in grounding.grounded(claims, F.col("t")).items())), t=text).asDict()
        return {k: v for k, v in row.items() if v not in (None, False)}

    assert of("todo bien") == {"wound": "normal"}
    assert of("me duele un poquito pero nada grave") == {"wound": "normal", "mentioned": True, "minimises": True}
    assert of("me duele siete de diez") == {"wound": "normal", "pain": 7.0}
    assert of("tengo 38 de fiebre") == {"wound": "normal", "fever": 38.0, "fever_felt": True}
    assert of("me sale un liquidito amarillo") == {"wound": "secrecion_purulenta"}
    assert of("nada de pus") == {"wound": "normal"}


@pytest.mark.parametrize(("text", "want"), [("fierebres", "fiebre"), ("la erida está bien", "la herida está bien"), ("sin fiebre", "sin fiebre"), ("tengo sin chasón.", "tengo hinchazón."), ("hola", "hola"), (None, None)])
def test_repair(spark, text, want):
    assert one(spark, speech_repair.repaired(F.col("t")), t=text) == want


def test_numbers_aloud():
    assert len(speech_repair.ALOUD) == 1000 == len(set(speech_repair.ALOUD))
    assert [speech_repair.ALOUD[n] for n in (0, 16, 31, 100, 101, 555, 999)] == ["cero", "dieciséis", "treinta y uno", "cien", "ciento uno", "quinientos cincuenta y cinco", "novecientos noventa y nueve"]
    assert speech_repair.read_aloud("Tiene 38.5 °C [1], dolor **7/10** y 20%") == "Tiene treinta y ocho punto cinco grados , dolor siete sobre diez y veinte por ciento"
    assert speech_repair.read_aloud("1234 y 5,07 o 12.345") == "1234 y cinco punto cero siete o doce.trescientos cuarenta y cinco"


def test_repair_with_a_vocabulary():
    fix = speech_repair.Repair(frozenset({"sanando", "punzada", "color"}))
    assert fix("sanando las punzadas y colores") == "sanando las punzadas y colores" and fix("fierebres") == "fiebre" and fix("amarillenta") == "amarillenta"


def streamed(parts, least=25):
    """What is said when, part by part: a sentence goes when the next one begins and it is long enough."""
    held, out = "", []
    for c in "".join(parts):
        held += c
        while (m := re.search(r"(?<=[.!?…])\s+(?=\S)", held)) and m.start() >= least:
            out, held = [*out, held[: m.start()]], held[m.end() :]
    rest = re.sub(r"(?<=[.!?…])\s+(?=\S)", " ", held).strip()
    return [x for x in [*(o.strip() for o in out), rest] if x]


def replies():
    r = random.Random(9)
    out = [list("Esta es una frase bastante larga. Y otra más larga todavía aquí. Sí. Fin"), [""], ["Una frase sola que no acaba"], ["  "]]
    for _ in range(25):
        text = "".join("palabra " * r.choice([0, 1, 3, 5]) + r.choice(["fin. ", "¡eh!  ", "ya…\n", "sigue "]) for _ in range(r.randint(1, 8)))
        cuts = sorted(r.randrange(len(text) + 1) for _ in range(r.randint(0, 9)))
        out.append([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])
    return out


def test_sentence_stream(spark):
    assert streamed(replies()[0]) == ["Esta es una frase bastante larga.", "Y otra más larga todavía aquí.", "Sí. Fin"]
    df = spark.createDataFrame(list(enumerate(replies())), "i int, parts array<string>")
    got = {r.i: r.s for r in df.select("i", speech_repair.sentence_stream(F.col("parts")).alias("s")).collect()}
    assert got == {i: streamed(p) for i, p in enumerate(replies())}


@pytest.mark.parametrize("seed", [0, 1])
def test_sentences_of_parts_in_any_order(spark, tmp_path, seed):
    rows = [(f"c{i % 3}", i, k, p, k == len(parts) - 1) for i, parts in enumerate(replies()) for k, p in enumerate(parts)]
    schema = "call_id string, reply int, place int, text string, last boolean"
    random.Random(seed).shuffle(rows)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):
            spark.createDataFrame([*rows[k::3], *rows[k::6]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = speech_repair.sentences_as_they_come(stream).writeStream.format("memory").queryName(f"said{seed}").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
        q.processAllAvailable()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for r in sorted(spark.table(f"said{seed}").collect(), key=lambda r: r.n):
        got.setdefault(r.reply, []).append(r.sentence)
    assert got == {i: streamed(p) for i, p in enumerate(replies()) if streamed(p)}
    assert left == 0


def test_gain_does_not_depend_on_when_blocks_arrive():
    peaks = np.array([0.01, 0.2, np.nan, 0.001, 0.5, 0.0])
    whole, level, gain = signal.gains(peaks, 0.0, 1.0)
    one, now = [], (0.0, 1.0)
    for p in peaks:
        by, *now = signal.gains(np.array([p]), *now)
        one += by.tolist()
    assert one == whole.tolist() and tuple(now) == (level, gain) and whole[1] == whole[2] and (whole >= 1).all() and (whole <= signal.GAIN).all()
    assert np.isclose(whole[0], 1 + 0.25 * (12 - 1)) and np.isclose(level, 0.5 * 0.995)


def test_quality(spark):
    rng = np.random.default_rng(2)
    tone = np.sin(2 * np.pi * 1000 * np.arange(3200) / signal.RATE).tolist()
    odd = rng.normal(size=3200)
    rows = [("a", 1, tone), ("a", 2, [0.5] * 10), ("a", 3, odd.tolist()), ("a", 4, [0.0] * 1000), ("a", 5, rng.normal(size=801).tolist()), ("a", 6, [float("nan"), float("inf")] * 500)]
    got = {r.seq: r for r in signal.quality(spark.createDataFrame(rows, "call_id string, seq int, samples array<double>")).collect()}
    assert got[1].voice > 99 and abs(got[1].rms - 0.7071) < 1e-3 and got[2].rms is None and got[2].seconds == 0.0
    assert got[4].voice == got[4].rms == got[6].peak == 0.0
    for seq in (3, 5):
        x = np.array(rows[seq - 1][2])
        x = x - x.mean()
        spectrum = [(k * 16000 / len(x), abs(p) ** 2) for k, p in enumerate(np.fft.rfft(x * np.hanning(len(x))))]
        total = sum(p for hz, p in spectrum if hz < 8000)
        for name, low, high in (("voice", 300, 3000), ("high", 3000, 7000), ("rumble", 0, 300)):
            assert abs(got[seq][name] - 100 * sum(p for hz, p in spectrum if low <= hz < high) / total) < 0.06
        assert abs(got[seq].peak - abs(x).max()) < 1e-3 and abs(got[seq].rms - np.sqrt((x**2).mean())) < 1e-4


def test_samples_and_pending_sound(spark):
    raw = [np.array([0.5, np.nan, -np.inf], "<f4").tobytes() + b"ab", b"abc", b""]
    df = spark.createDataFrame([("a", i, bytearray(x)) for i, x in enumerate(raw)], "call_id string, seq int, sound binary").withColumn("samples", signal.samples("sound"))
    assert [r.samples for r in df.orderBy("seq").collect()] == [[0.5, 0.0, 0.0], [], []]
    two = spark.createDataFrame([("a", 2, [3.0]), ("a", 1, [1.0, 2.0])], "call_id string, seq int, samples array<double>")
    assert signal.joined(two, "call_id").first().samples == [1.0, 2.0, 3.0]


def test_filter_by_its_recurrence():
    rng = np.random.default_rng(3)
    x, sections = rng.normal(size=333), signal.butterworth(4, 90.0, 16000, True)
    want, z = x.copy(), np.zeros((2, 2))
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        for i, v in enumerate(want.tolist()):
            out = b0 * v + z[k][0]
            z[k] = b1 * v - a1 * out + z[k][1], b2 * v - a2 * out
            want[i] = out
    got, state = signal.filtered(x, sections, np.zeros((2, 2)))
    assert np.allclose(got, want) and np.allclose(state, z)


@pytest.mark.parametrize("rate", [8000, 16000, 44100, 48000])
def test_blocks_of_any_size_give_the_same_signal(rate):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    low = signal.butterworth(8, 7200.0, max(rate, 16001), False)
    whole, _ = signal.filtered(x, low, np.zeros((4, 2)))
    want, _, _ = signal.resampled(whole, rate / signal.RATE, 0.0, np.empty(0))
    cuts = [0, 1, 2, 3, 500, 501, 1777, 3000]
    got, state, at, tail = [], np.zeros((4, 2)), 0.0, np.empty(0)
    for a, b in zip(cuts, cuts[1:], strict=False):
        y, state = signal.filtered(x[a:b], low, state)
        y, at, tail = signal.resampled(y, rate / signal.RATE, at, tail)
        got.append(y)
    assert np.allclose(np.concatenate(got), want)


def test_filters_pass_what_they_should():
    t = np.arange(4800) / 16000
    high = signal.butterworth(4, 90.0, 16000, True)
    size = lambda f: np.abs(signal.filtered(np.sin(2 * np.pi * f * t), high, np.zeros((2, 2)))[0][2400:]).max()
    assert size(20) < 0.01 and size(1000) > 0.98 and abs(size(90) - 0.707) < 0.05


def test_guards_come_in_order(spark):
    from tamiz.operators import dialog

    lines = ["¿Cómo ha estado el dolor?", "en seis", "¿Cuál es su temperatura?", "mm", "¿Cómo está la herida?", "me sale pus", "¿Le quedó claro?", "sí", "¿Algo más?", "¿puedo caminar?", "¿Algo más?", "no gracias"]
    turns = spark.createDataFrame([("c", i, "assistant" if i % 2 == 0 else "user", t) for i, t in enumerate(lines)], "call_id string, turn int, role string, text string")
    assert [r.unclear for r in dialog.processed(turns).orderBy("turn").collect()] == [0, 1, 0, 0, 0, 0]
    got = [(r.action, r.alerted, r.next_item) for r in dialog.processed(turns).orderBy("turn").collect()]
    assert got == [("slot", False, "fiebre"), ("repeat", False, "fiebre"), ("escalate", False, "fiebre"), ("confirmation", True, "fiebre"), ("answer", True, "fiebre"), ("farewell", True, "fiebre")]


@pytest.mark.parametrize(("heard", "fixed", "want"), [("tengo fierbe", "tengo fiebre", "tengo fiebre"), ("hola", " ", "hola"), ("hola", "HOLA", "hola"), ("me duele", "Lo siento, no puedo ayudar", "me duele"), ("a" * 100, "corto", "a" * 100), ("no", "x" * 61, "no"), ("no", None, "no")])
def test_corrected(spark, heard, fixed, want):
    from tamiz.operators import dialog

    assert one(spark, dialog.corrected(F.col("a"), F.col("b")), a=heard, b=fixed) == want


def test_clamps_and_prompts(spark):
    from tamiz.operators import guards

    assert [one(spark, guards.whole_number(F.col("t"), 50), t=x) for x in ("33", "33.9", "1e9", "-4", "x", "", None, "NaN")] == [33, 33, 200, 0, 50, 50, 50, 50]
    assert [one(spark, guards.sample_rate(F.col("t")), t=x) for x in ("16000", "7999", "192001", "x", None)] == [16000, 48000, 48000, 48000, 48000]
    kind = lambda q, s, t: one(spark, guards.prompt_kind(F.col("q"), F.col("s"), F.lit(t), ["dolor"]), q=q, s=s)
    assert [kind("¿Le quedó claro?", "dolor", 2.0), kind("x", "dolor", 0.1), kind("x", "z", 1.6), kind(None, None, 0.8), kind("x", None, 0.5)] == ["confirmation", "dolor", "long", "short", "none"]
    assert one(spark, guards.last_part(F.col("t"), 3), t="abcdef") == "def"


def test_report(spark, tmp_path):
    from tamiz.operators import guards

    calls = spark.createDataFrame([(1, "Ana", "c1", "rojo", True, [], 2.5), (2, "Luis", "c2", None, False, ["T1: RAG espurio: x", "T2: STT muy distinto: «a|b»"], 1.0)], "call_id int, name string, case string, level string, ok boolean, issues array<string>, seconds double")
    assert tuple(guards.battery(calls).first()) == (2, 1, 1, 1)
    assert {(r.issue, r.calls) for r in guards.issue_counts(calls).collect()} == {("RAG espurio", 1), ("STT muy distinto", 1)}
    guards.write_report(calls, f"file://{tmp_path}/r")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/r/table").collect()) == ["| 1 | Ana | c1 | rojo | sí | — | 2.5 |", "| 2 | Luis | c2 | — | NO | T1: RAG espurio: x; T2: STT muy distinto: «a/b» | 1.0 |"]
    assert spark.read.json(f"file://{tmp_path}/r/json").count() == 2


def test_searches_that_nothing_asked_for(spark):
    cases = [("tengo dolor", "Permítame revisar sus indicaciones un momento.", True), ("¿puedo caminar con dolor?", "Permítame revisar.", False), ("tengo dolor", "De acuerdo.", False), ("hola", "Permítame revisar", False), (None, None, None)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, said string, reply string")
    got = {r.i: [x for x in r.issues if "RAG espurio" in x] for r in df.select("i", guards.reply_issues(F.col("said"), F.col("said"), F.col("reply")).alias("issues")).collect()}
    assert [bool(got[i]) for i in range(len(cases))] == [bool(c[2]) for c in cases]


def test_reports_as_files(spark, tmp_path):
    calls = spark.createDataFrame([(2, "Ana", "b", None, False, ["x|y: 1"], 2.5), (1, "Luz", "a", "rojo", True, [], 1.0)], "call_id int, name string, case string, level string, ok boolean, issues array<string>, seconds double")
    guards.write_report(calls, f"file://{tmp_path}/report")
    (file,) = (tmp_path / "report/table").glob("part-*")
    assert file.read_text().splitlines() == ["- Pacientes: **2**", "- OK: **1** · Fallos: **1**", "- Duración total: **3.5 s**", "| # | Paciente | Caso | Triaje | OK | Issues | s |", "|---|----------|------|--------|----|--------|---|", "| 1 | Luz | a | rojo | sí | — | 1.0 |", "| 2 | Ana | b | — | NO | x/y: 1 | 2.5 |"]
    for name, rows in (("some", calls), ("none", calls.limit(0))):
        records.write_array(rows, f"file://{tmp_path}/{name}", "call_id")
        (file,) = (f for f in (tmp_path / name).glob("part-*") if f.stat().st_size)
        assert [x["call_id"] for x in json.loads(file.read_text())] == ([1, 2] if name == "some" else [])
