"""What a call does with each patient turn: guards in their order, over the whole call, in one shuffle by call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import speech
from tamiz.operators import guards, slots
from tamiz.operators.rules import quick_red

# An assistant's voice in what should be a corrected transcript.
ASSISTANT = r"(?i)no puedo (?:proporcionar|ayudar|darte|responder)|te recomiendo|le recomiendo|lo siento|como asistente|consulta a (?:un|tu)|profesional de la salud|¿hay algo más|estoy aquí para"
#: Checklist of a call, in order.
CHECKLIST = ["dolor", "fiebre", "herida", "movilidad", "apetito_sueno"]
#: Messages of a call that are kept beyond so many: the first, and the last ones.
KEPT, RECENT = 9, 8


def corrected(heard: Column, fixed: Column) -> Column:
    """A corrected transcript, where it is plausible: not empty, another text, neither much shorter nor longer, and not an assistant's."""
    new, old = F.trim(fixed), F.trim(heard)
    size = F.length(old)
    good = (new != "") & (F.lower(new) != F.lower(old)) & (F.length(new) >= 0.4 * size) & (F.length(new) <= F.greatest(F.lit(60), 1.8 * size)) & ~new.rlike(ASSISTANT)
    return F.when(good, new).otherwise(heard)


def pruned(messages: DataFrame, by: str = "call_id", order: str = "turn") -> DataFrame:
    """The messages of each call: all of up to KEPT, else the first and the last RECENT."""
    w = Window.partitionBy(by)
    numbered = messages.withColumns({"_first": F.row_number().over(w.orderBy(order)), "_last": F.row_number().over(w.orderBy(F.desc(order))), "_all": F.count("*").over(w)})
    return numbered.where((F.col("_all") <= KEPT) | (F.col("_first") == 1) | (F.col("_last") <= RECENT)).drop("_first", "_last", "_all")


def told(answers: DataFrame) -> DataFrame:
    """Answers (question, text, ...) with what each says by itself: slot, status, alarm, confirmed, farewell, thanks,
    asks, and the domains that it makes known."""
    text, nothing = F.col("text"), F.lit(None).cast("string")
    made = answers.withColumn("slot", slots.asked(F.col("question"))).withColumn("got", slots.parsed(F.col("slot"), text)).withColumn("said", speech.extracted(text))
    known = {
        "dolor": F.coalesce(F.col("got.pain"), F.col("said.pain")).isNotNull(),
        "fiebre": F.coalesce(F.col("got.fever"), F.col("said.fever")).isNotNull() | F.coalesce(F.col("said.fever_felt"), F.col("got.no_fever")).isNotNull(),
        "herida": F.col("got.wound").isNotNull(),
        "apetito_sueno": F.col("got.appetite").isNotNull(),
    }
    sure = F.concat_ws(" ", F.col("question"), F.lit("¿Me confirma que quedó claro?"))
    columns = {
        "status": F.col("got.status"), "alarm": quick_red(text), "confirmed": slots.confirmed(text, sure).isNotNull(),
        "farewell": slots.farewell(text, F.col("slot"), F.lit(False)), "thanks": slots.farewell(text, nothing, F.lit(True)) & F.col("slot").isNull(),
        "question": guards.asks(text), "known": F.array_compact(F.array(*(F.when(c, name) for name, c in known.items()))),
    }
    return made.withColumns(columns).drop("got", "said")


def processed(turns: DataFrame) -> DataFrame:
    """(call_id, turn, slot, action, alarm, alerted, next_item, unclear) of the patient's turns (call_id, turn, role, text).

    action is the first that holds of: confirmation (after an alert), farewell, escalate (alarm phrase), slot (the asked
    datum is there), repeat (unclear), answer (a question), extract. unclear counts the answers in a row that were.
    """
    w = Window.partitionBy("call_id").orderBy("turn")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    asked = turns.withColumn("question", F.last(F.when(F.col("role") == "assistant", F.col("text")), True).over(before))
    mine = told(asked.where("role <> 'assistant'").select("call_id", "turn", "question", "text"))
    mine = mine.withColumn("alerted", F.coalesce(F.max(F.col("alarm").isNotNull()).over(before), F.lit(False)))
    action = (
        F.when(F.col("alerted") & F.col("confirmed"), "confirmation")
        .when(F.col("farewell") | (F.col("alerted") & F.col("thanks")), "farewell")
        .when(F.col("alarm").isNotNull() & ~F.col("alerted"), "escalate")
        .when(F.col("status") == "filled", "slot")
        .when(F.col("status") == "unclear", "repeat")
        .when(F.col("question"), "answer")
        .otherwise("extract")
    )
    mine = mine.withColumn("action", action)
    done = F.array_union(F.collect_set(F.when(F.col("action") == "slot", F.col("slot"))).over(upto), F.flatten(F.collect_set(F.when(F.size("known") > 0, F.col("known"))).over(upto)))
    following = F.try_element_at(F.array_except(F.array(*map(F.lit, CHECKLIST)), done), F.lit(1))
    # answers that were clear cut the turns into stretches; within one the unclear ones are counted
    mine = mine.withColumn("stretch", F.count_if(F.col("action") != "repeat").over(upto))
    strikes = F.count_if(F.col("action") == "repeat").over(Window.partitionBy("call_id", "stretch").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    unclear = F.when(F.col("action") == "repeat", strikes).otherwise(0).cast("int")
    return mine.select("call_id", "turn", "slot", "action", "alarm", "alerted", following.alias("next_item"), unclear.alias("unclear"))
