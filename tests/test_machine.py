"""The call machine: its rules are the columns' rules, its guards keep their order, and a stream says what the table says."""

import random

import pytest
from pyspark.sql import functions as F

from tamiz.operators import rules
from tamiz.streaming import machine

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_rules_are_those_of_the_columns(spark):
    r = random.Random(4)
    pick = lambda *x: r.choice([None, None, *x])
    rows = []
    for i in range(600):
        s = {"pain": pick(0.0, 3.0, 5.0, 7.5, 8.0, 10.0), "fever": pick(36.5, 37.8, 37.99, 38.0, 38.49, 38.5), "fever_felt": pick(1.0, 0.0), "wound": pick(*map(float, range(7))), "pain_worse": pick(1.0, 0.0)}
        s |= {k: pick(1.0, 0.0, 0.0, 0.0) for k in ("bleeding", "dyspnoea", "vomiting")} | {"appetite": pick(0.0, 1.0), "sleep": pick(0.0, 1.0), "minimising": float(r.choice([0, 0, 1, 2])), "unquantified": float(r.random() < 0.3)}
        others = r.sample([*rules.RED_TEXT, *rules.YELLOW_TEXT], r.choice([0, 0, 0, 1]))
        rows.append((i, r.choice(["", "Reemplazo de cadera"]), r.choice([1, 2, 3, 7]), others, s))
    got = {}
    for i, procedure, day, others, s in rows:
        held = {k: v for k, v in s.items() if v is not None} | {f"text:{p}": 1.0 for p in others} | ({"leg": 1.0} if any("pantorrilla" in p or "pierna hinchada" in p for p in others) else {})
        got[i] = max((x for x, _ in machine.fired(held, "cadera" in procedure, day)), default=0)
    kinds = "i int, procedure string, day int, said array<string>, " + ", ".join(f"{c} double" for c in machine.SYMPTOMS) + ", minimising int, unquantified boolean"
    df = spark.createDataFrame([(i, p, d, o, *(s[c] for c in machine.SYMPTOMS), int(s["minimising"]), bool(s["unquantified"])) for i, p, d, o, s in rows], kinds)
    made = machine.state(df).withColumn("others", F.col("said"))
    level = rules.evaluate(made, F.col("procedure"), F.col("day"))["level"]
    want = {x.i: rules.LEVELS.index(x.level) for x in made.select("i", level.alias("level")).collect()}
    assert got == want and set(want.values()) == {0, 1, 2}


LINES = {
    "pus": [("¿Cómo ha estado el dolor?", "en seis"), ("¿Cuál es su temperatura?", "mm"), ("¿Cuál es su temperatura?", "mm"), ("¿Cuál es su temperatura?", "mm"), ("¿Cuál es su temperatura?", "no he tenido fiebre"), ("¿Cómo está la herida?", "me sale pus"), ("¿Me confirma que quedó claro?", "sí, quedó claro"), ("¿Algo más?", "¿puedo caminar?"), ("¿Algo más?", "me falta el aire"), ("¿Algo más?", "gracias")],
    "fever": [("¿Cómo ha estado el dolor?", "en dos"), ("¿Cuál es su temperatura?", "treinta y nueve"), ("¿Me confirma que quedó claro?", "no entendí")],
    "calm": [("¿Cómo ha estado el dolor?", "en uno"), ("¿Cuál es su temperatura?", "treinta y seis y medio"), ("¿Cómo está la herida?", "normal"), ("¿Algo más?", "¿cuándo puedo bañarme?"), ("¿Algo más?", "no gracias")],
    "climbs": [("¿Algo más que quiera contar?", "el dolor va empeorando"), ("¿Algo más que quiera contar?", "tengo treinta y ocho de fiebre"), ("¿Algo más que quiera contar?", "el dolor está en ocho")],
}


def answers(spark):
    rows = [(k, i, 1_700_000_000 + 7 * i + 90 * (k == "climbs" and i > 1) + n, q, a) for n, (k, lines) in enumerate(sorted(LINES.items())) for i, (q, a) in enumerate(lines)]
    return spark.createDataFrame(rows, "call_id string, turn int, s long, question string, text string").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def told(df, *more):
    keep = ("call_id", "at", "turn", "action", "raised", "level", "call_level", "next_item", "unclear", "searches", "turns", "cause", *more)
    return sorted((tuple(r) for r in df.select(*keep).collect()), key=repr)


@pytest.fixture(scope="module")
def batch(spark):
    return machine.replayed(answers(spark)).cache()


def test_guards_levels_and_close(batch):
    said = {}
    for r in sorted(batch.collect(), key=lambda r: (r.at, r.turn is None)):
        said.setdefault(r.call_id, []).append(r)
    assert [r.action for r in said["pus"]] == ["slot", "repeat", "repeat", "call_people", "slot", "escalate", "confirmation", "answer", "reply", "farewell", "closed"]
    assert [r.call_level for r in said["pus"]] == ["amarillo"] * 5 + ["rojo"] * 6
    assert [r.raised for r in said["pus"]] == [False] * 5 + [True, False, False, True, False, False]  # a second red reason is told too
    assert said["pus"][-1].cause == "farewell" and said["pus"][-1].turns == 10 and said["pus"][-1].searches == 1
    assert [r.action for r in said["fever"]] == ["slot", "escalate", "confirmation", "nudge", "nudge", "nudge", "closed"]
    assert [r.next_item for r in said["calm"]][:3] == ["fiebre", "herida", "movilidad"] and said["calm"][-1].call_level == "verde"
    assert [r.action for r in said["climbs"]] == ["reply", "reply", "nudge", "nudge", "nudge", "escalate", "nudge", "nudge", "nudge", "closed"]
    assert said["climbs"][-1].cause == "silence" and sum(r.action == "closed" for r in said["climbs"]) == 1


@pytest.mark.parametrize("seed", [0, 1])
def test_a_stream_in_any_order_says_what_the_table_says(spark, batch, tmp_path, seed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        end = spark.createDataFrame([("end", 0, 1_700_009_000, "", "mm")], "call_id string, turn int, s long, question string, text string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        r = random.Random(seed)
        rows = sorted(answers(spark).collect(), key=lambda x: x.ts.timestamp() + 25 * r.random())  # up to 25 s late, of 30 allowed
        df = answers(spark)
        for k in range(4):
            part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
            r.shuffle(part)
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            if k == 0:
                stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
                q = machine.machine(stream).writeStream.format("memory").queryName(f"machine{seed}").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
            q.processAllAvailable()
        end.select(*df.columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
        state = q.lastProgress["stateOperators"][0]
        q.stop()
        got = spark.table(f"machine{seed}").where("call_id <> 'end'")
        assert told(got, *machine.SYMPTOMS) == told(batch, *machine.SYMPTOMS)
        # what is left is the one turn that no later one has passed
        assert state["customMetrics"].get("numValueStateVars", 1) >= 1 and state["numRowsTotal"] <= 4
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
