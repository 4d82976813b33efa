"""The call machine on transformWithState: guards in their order, symptoms that only get worse, levels, escalation, nudges, close.

What a turn says by itself is told by columns. A keyed processor keeps a call's typed state: its turns wait in a list until the
watermark has passed them, so they are handled in the order of their time however they arrive; the call's marks are a value,
its symptoms and what is known of the checklist are maps. Event-time timers say when turns are due, when silence is
broken, and when a call that has gone silent is over. At farewell or at that time one summary row comes out and all state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tamiz.functions import speech
from tamiz.functions.text import fold
from tamiz.operators import grounding, guards, slots
from tamiz.operators.dialog import CHECKLIST
from tamiz.operators.rules import APPETITE, LEVELS, RED_TEXT, WOUND, YELLOW_TEXT, quick_red

#: Idle seconds before silence is broken, how often that is, and idle seconds after which a call is over.
IDLE_S, NUDGES, OVER_S = 20, 3, 120
#: How far behind the latest turn one may come.
DELAY = "30 seconds"
#: Unclear answers in a row after which people are called in.
STRIKES = 3
#: Numbers that a turn can make known; flags are 1, a wound and an appetite their places in the orders of severity.
SYMPTOMS = ["pain", "fever", "fever_felt", "wound", "pain_worse", "bleeding", "dyspnoea", "vomiting", "appetite", "sleep"]
TOLD = [
    "turn int", "at long", "slot string", "status string", "alarm string", "confirmed boolean", "farewell boolean", "thanks boolean", "question boolean", "worth boolean", "joint boolean", "day int",
    "mentioned boolean", "minimises boolean", "no_fever boolean", "leg boolean", "phrases array<string>", *(f"slot_{s} double" for s in SYMPTOMS), *(f"free_{s} double" for s in SYMPTOMS),
]
OUT = "call_id string, turn int, at timestamp, action string, raised boolean, level string, call_level string, next_item string, unclear int, searches int, turns int, alerted boolean, cause string, " + ", ".join(f"{s} double" for s in SYMPTOMS) + ", minimising int, unquantified boolean"
NAMES = [c.split()[0] for c in OUT.split(", ")]


def told(answers: DataFrame) -> DataFrame:
    """answers (call_id, turn, ts, question, text[, procedure, day]) with what each says by itself: the columns of TOLD."""
    text, nothing = F.col("text"), F.lit(None).cast("string")
    procedure = fold(F.coalesce("procedure", F.lit(""))) if "procedure" in answers.columns else F.lit("")
    day = F.coalesce(F.col("day").cast("int"), F.lit(1)) if "day" in answers.columns else F.lit(1)
    # what several columns read is a column itself, so that it is worked out once for each turn
    made = answers.withColumns({"slot": slots.asked(F.col("question")), "said": speech.extracted(text), "alarm": quick_red(text), "own": speech.own(fold(F.coalesce(text, F.lit(""))))})
    made = made.withColumn("got", slots.parsed(F.col("slot"), text, F.col("alarm")))
    place = lambda c, order: F.when(c.isNotNull(), F.array_position(F.array(*map(F.lit, order)), c) - 1)
    number = lambda c: c.cast("double")
    free = {name: number(F.col(f"said.{name}")) for name in ("pain", "fever", "fever_felt", "pain_worse", "bleeding", "dyspnoea")}
    slot = dict(free)
    slot |= {name: F.greatest(number(F.col(f"got.{name}")), free[name]) for name in ("pain", "fever")}
    slot |= {"wound": place(F.col("got.wound"), WOUND), "appetite": place(F.col("got.appetite"), APPETITE)}
    own, alarm = F.col("own"), F.col("alarm")
    sure = F.concat_ws(" ", F.col("question"), F.lit("¿Me confirma que quedó claro?"))
    watched = F.array_compact(F.array(*(F.when(F.contains(own, F.lit(p)), F.lit(p)) for p in YELLOW_TEXT)))
    columns = {
        "at": F.unix_millis(F.col("ts").cast("timestamp")), "status": F.col("got.status"), "confirmed": slots.confirmed(text, sure).isNotNull(),
        "farewell": slots.farewell(text, F.col("slot"), F.lit(False)), "thanks": slots.farewell(text, nothing, F.lit(True)) & F.col("slot").isNull(), "question": guards.asks(text), "worth": guards.worth_extracting(text),
        "joint": procedure.rlike("articular|cadera|rodilla"), "day": day, "mentioned": own.rlike(grounding.PAIN), "minimises": own.rlike(grounding.MINIMISES), "no_fever": F.col("got.no_fever"),
        "leg": own.rlike("pantorrilla|pierna hinchada"), "phrases": F.array_union(F.array_compact(F.array(F.when(alarm.isin(*RED_TEXT), alarm))), watched),
    }
    for kind, found in (("slot", slot), ("free", free)):
        columns |= {f"{kind}_{name}": found.get(name, F.lit(None)).cast("double") for name in SYMPTOMS}
    made = made.withColumns(columns)
    return made.select(F.col("call_id").cast("string").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), *(F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in TOLD))


def fired(s: dict[str, float], joint: bool, day: int) -> set[tuple[int, str]]:
    """(severity, rule) of all rules that hold for a state: rules.evaluate for one state at a time, without its sentences."""
    pain, fever, wound, felt, worse = (s.get(k) for k in ("pain", "fever", "wound", "fever_felt", "pain_worse"))
    warm = fever if fever is not None else 0.0
    altered, evaded = wound in (2, 3, 4), bool(s.get("unquantified")) and pain is None
    soft = [altered or wound == 1, bool(felt and fever is None) or 37.8 <= warm < 38.0, s.get("appetite") is not None, s.get("sleep") == 1, evaded and s.get("minimising", 0) >= 1]
    texts = [k[5:] for k in s if k.startswith("text:")]
    red = {
        "fever": warm >= 38.5, "pain": pain is not None and pain >= 8, "open": wound == 6, "pus": wound == 5, "bleeding": s.get("bleeding") == 1, "dyspnoea": s.get("dyspnoea") == 1,
        "vomiting": s.get("vomiting") == 1, "leg": joint and "leg" in s, "many": sum(soft) >= 3, **{f"said {p}": True for p in texts if p in RED_TEXT},
    }
    amber = {
        "fever": 38.0 <= warm < 38.5, "pain": pain is not None and 5 <= pain < 8, "worse": bool(worse) and (pain is None or (pain < 5 and day >= 3)), "wound": altered,
        "infection": altered and (warm >= 38.0 or bool(felt)), "two": sum(soft) == 2, **{f"said {p}": True for p in texts if p in YELLOW_TEXT},
    }
    return {(2, k) for k, v in red.items() if v} | {(1, k) for k, v in amber.items() if v}


class Call:
    """A call so far; turns are handled in their order."""

    def __init__(self, marks: dict | None = None, symptoms: dict[str, float] | None = None, done: set[str] | None = None):
        self.m = marks or {"alerted": False, "unclear": 0, "severity": 0, "nudged": 0, "turns": 0, "searches": 0, "last": -1}
        self.s, self.done, self.over = symptoms or {}, done or set(), False

    def due(self, idle: int, most: int, over: int) -> int:
        """When, in ms, silence is to be broken next, or the call is over."""
        return self.m["last"] + (idle * (self.m["nudged"] + 1) if self.m["nudged"] < most else max(over, idle * (most + 1)))

    def silent(self, now: int, idle: int, most: int, over: int) -> list[dict]:
        """What silence up to a time brings: nudges, and the end of the call."""
        out = []
        while not self.over and self.m["last"] >= 0 and self.due(idle, most, over) <= now:
            at = self.due(idle, most, over)
            if self.m["nudged"] == most:
                out.append(self.close(at, "silence"))
            else:
                self.m["nudged"] += 1
                out.append(self.row(None, at, "nudge"))
        return out

    def row(self, turn: int | None, at: int, action: str, level: int | None = None, raised: bool = False, cause: str | None = None) -> dict:
        known = {name: self.s.get(name) for name in SYMPTOMS}
        following = next((k for k in CHECKLIST if k not in self.done), None)
        return {
            "turn": turn, "at": pd.Timestamp(at, unit="ms", tz="UTC"), "action": action, "raised": raised, "level": None if level is None else LEVELS[level], "call_level": LEVELS[self.m["severity"]], "next_item": following, "unclear": self.m["unclear"],
            "searches": self.m["searches"], "turns": self.m["turns"], "alerted": self.m["alerted"], "cause": cause, **known, "minimising": int(self.s.get("minimising", 0)), "unquantified": bool(self.s.get("unquantified", 0)),
        }

    def close(self, at: int, cause: str) -> dict:
        self.over = True
        return self.row(None, at, "closed", cause=cause)

    def merge(self, r: dict, kind: str) -> None:
        """Nothing gets better within a call but sleep, which is as last said; a temperature that cannot be is felt fever."""
        new = {name: r[f"{kind}_{name}"] for name in SYMPTOMS if r[f"{kind}_{name}"] is not None and r[f"{kind}_{name}"] == r[f"{kind}_{name}"]}
        if not 34.0 <= new.get("fever", 36.0) <= 43.0:
            del new["fever"]
            new["fever_felt"] = 1.0
        for name, value in new.items():
            self.s[name] = value if name == "sleep" else max(value, self.s.get(name, value))
        if kind == "free":
            self.s["minimising"] = self.s.get("minimising", 0.0) + bool(r["minimises"])
            if r["mentioned"] and "pain" not in new:
                self.s["unquantified"] = 1.0
            if r["worth"] or r["alarm"] is not None:
                self.s |= {f"text:{p}": 1.0 for p in r["phrases"]} | ({"leg": 1.0} if r["leg"] else {})
        if "pain" in new:
            self.s["unquantified"] = 0.0
        known = {"dolor": "pain" in self.s, "fiebre": "fever" in self.s or "fever_felt" in self.s or bool(r["no_fever"]), "herida": "wound" in self.s, "apetito_sueno": "appetite" in self.s or "sleep" in self.s}
        self.done |= {k for k, v in known.items() if v}

    def turn(self, r: dict) -> list[dict]:
        """The guards in their order: confirmation, farewell, alarm phrase, unclear, slot, extraction, level, escalation, answer."""
        m = self.m
        m["turns"] += 1
        m["last"], m["nudged"] = max(m["last"], r["at"]), 0
        out = lambda action, *a, **k: [self.row(r["turn"], r["at"], action, *a, **k)]
        unclear, m["unclear"] = m["unclear"], 0
        if m["alerted"] and r["confirmed"]:
            return out("confirmation")
        if r["farewell"] or (m["alerted"] and r["thanks"]):
            said = out("farewell")
            return [*said, self.close(r["at"], "farewell")]
        phrase = r["alarm"] is not None and not m["alerted"]
        if not phrase and r["status"] == "unclear":
            m["unclear"] = unclear + 1
            return out("call_people" if m["unclear"] == STRIKES else "repeat")
        slot = not phrase and r["status"] == "filled"
        before = fired(self.s, r["joint"], r["day"])
        self.merge(r, "slot" if slot else "free")
        if slot:
            self.done.add(r["slot"])
        now = fired(self.s, r["joint"], r["day"])
        level = 2 if phrase else max((x for x, _ in now), default=0)
        m["severity"] = max(m["severity"], level)
        if m["severity"] == 2 and not m["alerted"]:
            m["alerted"] = True
            return out("escalate", level, True)
        # another red reason after the alert reaches those who call back
        more = not slot and m["severity"] == 2 and any(x == 2 for x, _ in now - before)
        if not slot and r["question"]:
            m["searches"] += 1
        return out("slot" if slot else "answer" if r["question"] else "reply", level, more)


def _rows(key: str, out: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame([{"call_id": key, **o} for o in out], columns=NAMES)
    for c in ("turn", "unclear", "searches", "turns", "minimising"):
        df[c] = df[c].astype("Int32")
    for c in SYMPTOMS:
        df[c] = df[c].astype("float64")
    return df


class Processor(StatefulProcessor):
    """A call's state and timers; Call says what its turns do."""

    def __init__(self, idle_s: float, most: int, over_s: float):
        self.limits = (int(idle_s * 1000), most, int(over_s * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getValueState("marks", "alerted boolean, unclear int, severity int, nudged int, turns int, searches int, last long")
        self.symptoms = handle.getMapState("symptoms", "name string", "value double")
        self.done = handle.getMapState("done", "item string", "done boolean")
        self.waiting = handle.getListState("waiting", ", ".join(TOLD))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TOLD]
        for chunk in rows:
            for r in chunk[names].to_dict("records"):
                self.waiting.appendValue(tuple(_plain(r[c]) for c in names))
                self.handle.registerTimer(r["at"])
        yield _rows(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed: timers set here for earlier times would wait for the next batch
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        names = [c.split()[0] for c in TOLD]
        waiting = [dict(zip(names, r, strict=True)) for r in (self.waiting.get() if self.waiting.exists() else [])]
        marks = dict(zip(("alerted", "unclear", "severity", "nudged", "turns", "searches", "last"), self.marks.get(), strict=True)) if self.marks.exists() else None
        call = Call(marks, {k[0]: v[0] for k, v in self.symptoms.iterator()}, {k[0] for k in self.done.keys()})
        before = call.due(*self.limits) if marks else None
        out: list[dict] = []
        for r in sorted((r for r in waiting if r["at"] <= now), key=_order):
            out += call.silent(r["at"] - 1, *self.limits)
            call = Call() if call.over else call
            out += call.turn(r)
            call = _reopened(call)
        out += call.silent(now, *self.limits)
        left = [r for r in waiting if r["at"] > now]
        self.waiting.clear()
        if left:
            self.waiting.put([tuple(r[c] for c in names) for r in left])
        if before is not None:
            self.handle.deleteTimer(before)
        for r in left:  # one of them can be due at the same time
            self.handle.registerTimer(r["at"])
        self.symptoms.clear()
        self.done.clear()
        if call.over or call.m["last"] < 0:
            self.marks.clear()
        else:
            self.marks.update(tuple(call.m.values()))
            for k, v in call.s.items():
                self.symptoms.updateValue((k,), (float(v),))
            for k in call.done:
                self.done.updateValue((k,), (True,))
            self.handle.registerTimer(call.due(*self.limits))
        yield _rows(key[0], out)

    def close(self) -> None:
        pass


def _plain(v):
    """A pandas value as the state's types take it."""
    if v is None or (isinstance(v, float) and v != v):
        return None
    return list(v) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else v.item() if hasattr(v, "item") else v


def _order(r: dict) -> tuple:
    return r["at"], r["turn"]


def _reopened(call: Call) -> Call:
    """A call is over at its farewell; what comes after begins a new one."""
    return Call() if call.over else call


def machine(answers: DataFrame, delay: str = DELAY, idle_s: float = IDLE_S, most: int = NUDGES, over_s: float = OVER_S) -> DataFrame:
    """What a call does at each turn of a stream of answers (call_id, turn, ts, question, text[, procedure, day]), and more rows of
    action `nudge` and, once a call, `closed`.

    Turns are handled in the order of their time once the watermark has passed them; those that come later than `delay` are
    dropped by Spark and counted there. level is that of the turn, call_level never falls; raised marks a new alert, or
    another red reason after one. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = told(answers).where("call_id is not null and ts is not null").withWatermark("ts", delay)
    return rows.groupBy("call_id").transformWithStateInPandas(Processor(idle_s, most, over_s), OUT, "Append", "EventTime")


def replayed(answers: DataFrame, idle_s: float = IDLE_S, most: int = NUDGES, over_s: float = OVER_S) -> DataFrame:
    """machine() over a table: all turns of a call in their order, then silence.

    Calls are dealt to as many tasks as a shuffle has: their work is in Python, and by their few bytes Spark would put them all in one.
    """
    limits, kinds = (int(idle_s * 1000), most, int(over_s * 1000)), to_arrow_schema(StructType.fromDDL(OUT))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        call, out = Call(), []
        for r in sorted(rows.to_pylist(), key=_order):
            out += call.silent(r["at"] - 1, *limits)
            call = _reopened(call)
            out += call.turn(r)
            call = _reopened(call)
        return pa.Table.from_pylist([{"call_id": key[0].as_py(), **o} for o in [*out, *call.silent(1 << 62, *limits)]], kinds)

    tasks = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = told(answers).where("call_id is not null and ts is not null").drop("ts").repartition(tasks, "call_id")
    return dealt.groupBy("call_id").applyInArrow(run, OUT)


def state(rows: DataFrame) -> DataFrame:
    """The machine's rows with their symptoms as rules.evaluate takes them."""
    named = lambda c, order: F.element_at(F.array(*map(F.lit, order)), F.coalesce(F.col(c).cast("int") + 1, F.lit(1)))
    flags = {c: F.col(c) == 1 for c in ("fever_felt", "pain_worse", "bleeding", "dyspnoea", "vomiting")}
    return rows.withColumns({**flags, "wound": F.when(F.col("wound").isNotNull(), named("wound", WOUND)), "appetite": F.when(F.col("appetite").isNotNull(), named("appetite", APPETITE)), "sleep": F.when(F.col("sleep") == 1, "alterado").when(F.col("sleep") == 0, "normal"), "others": F.array().cast("array<string>")})
