"""Symptoms of calls: worst-of merge, state that only gets worse, and the level that rules give it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions.speech import bound, own, said
from tamiz.functions.text import fold

# Levels and orders of severity.
LEVELS = ["verde", "amarillo", "rojo"]
WOUND = ["normal", "enrojecida_leve", "enrojecida", "hinchada", "secrecion_clara", "secrecion_purulenta", "abierta"]
APPETITE = ["reducido", "nulo"]
# Phrases of free text that make a level.
RED_TEXT = [
    "dolor en el pecho", "dolor toracico", "no puedo respirar", "confusion", "confundid", "desmay", "convulsion",
    "sangrado abundante", "mucha sangre", "labios morados", "pantorrilla hinchada", "pierna hinchada y caliente", "pus",
    "se abrio la herida", "herida abierta", "vomito con sangre", "no orino", "sin orinar", "se me abrio",
    "abrio la herida", "se abrio la incision", "reventaron los puntos", "se me reventaron", "soltaron los puntos",
    "se abrieron los puntos", "se me solto la herida", "se me salieron los puntos",
]
YELLOW_TEXT = ["escalofrio", "pantorrilla", "se extiende", "se esta extendiendo", "no he podido comer nada", "vomite varias veces", "muchos vomitos"]
QUICK_RED = [*RED_TEXT, "huele feo", "huele mal", "mal olor", "liquido amarillo", "liquidito amarillo", "liquido verde", "amarillit", "amarillent", "verdos", "no aguanto el dolor", "dolor insoportable"]

NUMBERS, FLAGS = ["pain", "fever"], ["fever_felt", "pain_worse", "bleeding", "dyspnoea", "vomiting"]


def quick_red(text: Column) -> Column:
    """The first alarm phrase of a turn that is about the speaker and not negated, else null."""
    return bound(own(fold(F.coalesce(text, F.lit("")))), lambda t: said(t, QUICK_RED))


def worst(base: dict[str, Column], extra: dict[str, Column]) -> dict[str, Column]:
    """Two extractions as one: larger numbers, either flag, and of other fields the first one's where it has any."""
    out = {}
    for name in base:
        a, b = base[name], extra[name]
        out[name] = F.greatest(a, b) if name in (*NUMBERS, *FLAGS) else F.coalesce(a, b)
    return out


def ordinal(c: Column, order: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(c.isNotNull() & (at > 0), at)


def named(place: Column, order: list[str]) -> Column:
    """The name at a place of an order; null without one."""
    return F.when(place.isNotNull(), F.element_at(F.array(*map(F.lit, order)), F.coalesce(place, F.lit(1)).cast("int")))


def running_state(turns: DataFrame, call: str = "call_id", turn: str = "turn") -> DataFrame:
    """Each turn with the state of its call so far: nothing gets better within a call.

    turns has pain, fever, fever_felt, wound, pain_worse, bleeding, dyspnoea, vomiting, appetite, sleep, mentioned
    (pain without a number), minimises, others (array). A temperature outside 34..43 counts as felt fever only.
    One shuffle by call; all state is window functions over it.
    """
    w = Window.partitionBy(call).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    odd = F.coalesce(~F.col("fever").between(34.0, 43.0), F.lit(False))
    turns = turns.withColumns({"fever_felt": F.when(odd, True).otherwise(F.col("fever_felt")), "fever": F.when(~odd, F.col("fever"))})
    event = F.when(F.col("pain").isNotNull(), False).when(F.col("mentioned"), True)
    state = {name: F.max(name).over(w) for name in (*NUMBERS, *FLAGS)}
    state |= {name: named(F.max(ordinal(F.col(name), order)).over(w), order) for name, order in (("wound", WOUND), ("appetite", APPETITE))}
    state["sleep"] = F.last("sleep", ignorenulls=True).over(w)
    state["unquantified"] = F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False))
    state["minimising"] = F.coalesce(F.sum(F.col("minimises").cast("int")).over(w), F.lit(0)).cast("int")
    named_others = F.filter("others", lambda x: x != "")  # turns without any add nothing to the list
    state["others"] = F.array_distinct(F.flatten(F.collect_list(F.when(F.size(named_others) > 0, named_others)).over(w)))
    return turns.select(call, turn, *(c.alias(name) for name, c in state.items()))


def short(c: Column) -> Column:
    """A number as short as it can be written; null of none."""
    return F.when(c.isNotNull(), F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", ""))


def evaluate(s: DataFrame, procedure: Column | None = None, day: Column | None = None) -> Column:
    """struct<level, reasons, missing> of a state, by about twenty threshold rules; all that fire are named in order. The level alone
    takes no sentences: where nothing else is read of the struct, none are made."""
    c = {name: s[name] for name in (*NUMBERS, *FLAGS, "wound", "appetite", "sleep", "unquantified", "minimising", "others")}
    procedure, day = fold(F.coalesce(procedure if procedure is not None else F.lit(""), F.lit(""))), day if day is not None else F.lit(1)
    true = lambda x: F.coalesce(x, F.lit(False))
    pain, fever, wound = c["pain"], c["fever"], c["wound"]
    worse, felt = true(c["pain_worse"]), true(c["fever_felt"])
    others = fold(F.array_join(F.coalesce(c["others"], F.array().cast("array<string>")), " "))
    of = lambda *pairs: F.array_compact(F.array(*(F.when(true(cond), reason if isinstance(reason, Column) else F.lit(reason)) for cond, reason in pairs)))

    altered = true(wound.isin("enrojecida", "hinchada", "secrecion_clara"))
    evaded = c["unquantified"] & pain.isNull()
    fires = lambda pairs: reduce(lambda x, y: x | y, (true(cond) for cond, _ in pairs))
    mild = [
        (altered | (wound == "enrojecida_leve"), "herida alterada (aunque la describe leve)"),
        ((felt & fever.isNull()) | ((fever >= 37.8) & (fever < 38.0)), "sensación febril o febrícula"),
        (c["appetite"].isin(*APPETITE), "apetito reducido"),
        (c["sleep"] == "alterado", "sueño alterado"),
        (evaded & (c["minimising"] >= 1), "dolor evadido sin cuantificar (paciente que minimiza)"),
    ]
    soft, many = of(*mild), sum((true(cond).cast("int") for cond, _ in mild), F.lit(0))
    named = F.array_join(soft, "; ")
    phrases = F.filter(F.array(*map(F.lit, RED_TEXT)), lambda p: F.contains(others, p))
    red_first = [
        (fever >= 38.5, F.concat(F.lit("Fiebre de "), short(fever), F.lit(" °C (umbral de alarma ≥38.5)"))),
        (pain >= 8, F.concat(F.lit("Dolor "), short(pain), F.lit("/10 (severo)"))),
        (wound == "abierta", "Herida abierta (dehiscencia)"),
        (wound == "secrecion_purulenta", "Secreción purulenta o de mal olor en la herida"),
        (c["bleeding"], "Sangrado activo"),
        (c["dyspnoea"], "Dificultad para respirar"),
        (c["vomiting"], "Vómito persistente"),
    ]
    red_last = [
        (procedure.rlike("articular|cadera|rodilla") & others.rlike("pantorrilla|pierna hinchada"), "Dolor/hinchazón de pantorrilla tras reemplazo articular: descartar trombosis"),
        (many >= 3, F.concat(F.lit("Múltiples dominios afectados a la vez ("), named, F.lit(")"), F.when(c["minimising"] >= 1, " en paciente que minimiza activamente ('uno aguanta')").otherwise(""), F.lit(": cuadro incongruente con evolución normal"))),
    ]
    red = F.concat(of(*red_first), F.transform(phrases, lambda p: F.concat(F.lit("Signo de alarma referido: «"), p, F.lit("»"))), of(*red_last))
    said_red = F.array_join(phrases, "\n")
    watch = F.filter(F.array(*map(F.lit, YELLOW_TEXT)), lambda p: F.contains(others, p) & ~F.contains(said_red, p))
    amber_first = [
        ((fever >= 38.0) & (fever < 38.5), F.concat(F.lit("Fiebre de "), short(fever), F.lit(" °C (38.0–38.4: vigilancia)"))),
        ((pain >= 5) & (pain < 8), F.concat(F.lit("Dolor "), short(pain), F.when(worse, "/10 en aumento").otherwise("/10 (moderado)"))),
        ((pain < 5) & worse & (day >= 3), "Dolor que empeora pasado el día 3"),
        (pain.isNull() & worse, "Dolor en aumento sin cuantificar"),
        (wound == "secrecion_clara", "Secreción clara en la herida"),
        (wound == "enrojecida", "Enrojecimiento notorio de la herida"),
        (wound == "hinchada", "Hinchazón alrededor de la herida"),
    ]
    amber_last = [
        (altered & (true(fever >= 38.0) | felt), "Fiebre/febrícula + herida alterada: vigilar posible infección del sitio quirúrgico"),
        (many == 2, F.concat(F.lit("Varias molestias simultáneas ("), named, F.lit(")"))),
    ]
    amber = F.concat(of(*amber_first), F.transform(watch, lambda p: F.concat(F.lit("Síntoma a vigilar: «"), p, F.lit("»"))), of(*amber_last))
    ask_pain = "intensidad del dolor de 0 a 10"
    missing = of((fever.isNull() & felt, "temperatura medida con termómetro"), (pain.isNull() & worse, ask_pain), (evaded, ask_pain))
    # a phrase to watch counts where no red one says it, and there is no red one where amber is asked for
    is_red = fires(red_first) | others.rlike("|".join(RED_TEXT)) | fires(red_last)
    is_amber = fires(amber_first) | others.rlike("|".join(YELLOW_TEXT)) | fires(amber_last)
    return F.struct(
        F.when(is_red, LEVELS[2]).when(is_amber, LEVELS[1]).otherwise(LEVELS[0]).alias("level"),
        F.when(is_red, red).when(is_amber, amber).otherwise(F.array(F.lit("Sin signos de alarma en lo reportado"))).alias("reasons"),
        F.when(is_red, F.array().cast("array<string>")).otherwise(missing).alias("missing"),
    )


def running_level(evaluated: DataFrame, call: str = "call_id", turn: str = "turn") -> DataFrame:
    """The level of each call so far: a level never falls, though a single evaluation may."""
    w = Window.partitionBy(call).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return evaluated.withColumn("call_level", named(F.max(ordinal(F.col("level"), LEVELS)).over(w), LEVELS))
