"""Records that a call leaves behind: what an extraction is asked, alerts, one summary a call, and reports as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.operators.rules import LEVELS, evaluate

#: Characters of the last question that an extraction is given.
QUESTION = 220
# Fixed value: how the question and the answer are put to it.
ASKED = "El AGENTE preguntó: «%s»\nEl PACIENTE respondió (transcripción telefónica): «%s»"


def extraction_inputs(turns: DataFrame, by: str = "call_id", patient: str = "user") -> DataFrame:
    """(by, turn, content) of a patient's turns: the assistant's last message before it, cut, and what was answered."""
    before = Window.partitionBy(by).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = turns.withColumn("asked", F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(before))
    content = F.format_string(ASKED, F.left(F.coalesce("asked", F.lit("")), F.lit(QUESTION)), F.coalesce("text", F.lit("")))
    return asked.where(F.col("role") == patient).select(by, "turn", content.alias("content"))


def evaluated(state: DataFrame, procedure: Column | None = None, day: Column | None = None) -> DataFrame:
    """Running states with `severity` (0 to 2), reasons, and the known symptoms as one JSON object."""
    names = [c for c in ("pain", "fever", "fever_felt", "wound", "pain_worse", "bleeding", "dyspnoea", "vomiting", "appetite", "sleep", "unquantified", "minimising") if c in state.columns]
    found = state.withColumn("_found", evaluate(state, procedure, day))
    severity = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("_found.level")).cast("int") - 1
    return found.withColumns({"severity": severity, "reasons": F.col("_found.reasons"), "symptoms": F.to_json(F.struct(*names))}).drop("_found")


def alerts(found: DataFrame, *more: str, by: str = "call_id") -> DataFrame:
    """(by, turn, level, reasons, symptoms, more..): a call's first turn of the top level, as the alert that goes out then."""
    top = found.where(F.col("severity") == len(LEVELS) - 1)
    first = top.groupBy(by).agg(F.min_by(F.struct("turn", "reasons", "symptoms", *more), "turn").alias("x"))
    return first.select(by, "x.turn", F.lit(LEVELS[-1]).alias("level"), "x.reasons", "x.symptoms", *(f"x.{c}" for c in more))


def first_alerts(state: DataFrame, *more: str, by: str = "call_id", procedure: Column | None = None, day: Column | None = None) -> DataFrame:
    """alerts() of running states: the level alone finds a call's first turn of the top one, and only that turn gets its reasons."""
    top = state.where(evaluate(state, procedure, day)["level"] == LEVELS[-1])
    first = top.groupBy(by).agg(F.min_by(F.struct(*(c for c in state.columns if c != by)), "turn").alias("x")).select(by, "x.*")
    return alerts(evaluated(first, procedure, day), *more, by=by)


def summaries(found: DataFrame, *last: str, by: str = "call_id") -> DataFrame:
    """(by, turns, final_level, alerted, alert_turn, symptoms, reasons, last..): one row a call, by one partial aggregate.

    A level never falls in a call; reasons are those of the first turn of its final level; symptoms and the `last` columns are those of the last turn.
    """
    top = len(LEVELS) - 1
    worst = F.struct(F.col("severity").alias("s"), (-F.col("turn")).alias("t"))
    one = found.groupBy(by).agg(
        F.count("*").alias("turns"), F.max("severity").alias("severity"), F.min(F.when(F.col("severity") == top, F.col("turn"))).alias("alert_turn"),
        F.max_by(F.struct("symptoms", *last), "turn").alias("end"), F.max_by("reasons", worst).alias("reasons"),
    )
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("severity") + 1)
    return one.select(by, "turns", level.alias("final_level"), F.col("alert_turn").isNotNull().alias("alerted"), "alert_turn", "end.symptoms", "reasons", *(f"end.{c}" for c in last))


def array_lines(rows: DataFrame, order: str) -> DataFrame:
    """(order, line): rows as the lines of one JSON array, in the order of a unique column; its two ends are found first."""
    ends = rows.agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    line = F.concat(F.when(F.col(order) == F.col("_first"), "[").otherwise(" "), F.to_json(F.struct(*rows.columns)), F.when(F.col(order) == F.col("_last"), "]").otherwise(","))
    return rows.crossJoin(F.broadcast(ends)).select(order, line.alias("line"))


def write_array(rows: DataFrame, path: str, order: str) -> None:
    """Rows as one file that holds one JSON array; one task writes it line by line. No rows give an empty array."""
    lines = array_lines(rows, order)
    lines = lines if not rows.isEmpty() else rows.sparkSession.createDataFrame([(None, "[]")], lines.schema)
    lines.repartitionByRange(1, order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)
