"""Numbers, negation and other people in transcribed Spanish, as Column expressions over folded text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions.text import fold

# Number words.
NUMBERS = {"cero": 0, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19, "veinte": 20, "treinta": 30, "cuarenta": 40}
# Patterns.
NOT_A_MEASURE = r"(?:hora|dia|minuto|semana|mes|ano|punto de sutura|puntos|pastilla|tableta|capsula|gota|veces|vez|cucharada|mg|ml|miligramo|centimetro|cm|noche|manana|tarde)"
OTHERS = r"\b(?:mi|el|la|su)\s+(?:hij[oa]|mama|papa|espos[oa]|marido|mujer|herman[oa]|niet[oa]|abuel[oa]|vecin[oa]|amig[oa]|suegr[oa]|yern[oa]|nuera|primo|prima|ti[oa]|sobrin[oa])\b"
FIRST_PERSON = r"\b(?:tengo|siento|estoy|ando|amaneci|me\s+\w+|mi\s+(?:herida|cirugia|operacion|dolor|puntos|pierna|barriga)|mio|mia|yo|conmigo)\b"
NEGATION = r"(?:nada de|sin|no hay|no tengo|no me sale|ni|no veo|tampoco)\s+(?:\w+\s+){0,3}$"
FEVER_BEFORE = r"fiebre|temperatura|calentur|termometr|febril|marco|tengo|estaba|esta en|subio|paso de|mas de"


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is worked out once for each row, however often use names it."""
    return F.transform(F.array(c), use)[0]


def digits(c: Column) -> Column:
    """Number words of folded text as digits: treinta y nueve, nueve, 38 punto 5."""
    values = F.create_map(*(x for word, value in NUMBERS.items() for x in (F.lit(word), F.lit(f"\u0001{value}"))))
    words = F.transform(F.split(c, r"\b"), lambda w: F.coalesce(F.try_element_at(values, w), w))
    # the mark tells numbers that were words from those that were digits
    joined = F.regexp_replace(F.array_join(words, ""), r"\x01([234])0\s+y\s+\x01([1-9])\b", "$1$2")
    return F.regexp_replace(F.translate(joined, "\u0001", ""), r"\b(\d+)\s+(?:punto|coma|con)\s+(\d+)\b", "$1.$2")


def own(c: Column) -> Column:
    """Folded text without the clauses about somebody else, unless they speak of the speaker too."""
    clauses = F.split(c, r"(?<=[.!?,;])\s+|\s+(?:pero|aunque|y)\s+")
    return F.array_join(F.filter(clauses, lambda x: ~x.rlike(OTHERS) | x.rlike(FIRST_PERSON)), " ")


def matches(c: Column, pattern: str, before: int, after: int) -> Column:
    """Each match of a pattern with what stands before and after it: array<struct<value, before, after>>."""

    def found(parts: Column) -> Column:
        def at(k: Column) -> Column:
            def cut(rest: Column) -> Column:
                end = F.instr(rest, "\u0002")
                return F.struct(
                    F.substring(rest, F.lit(1), end - 1).alias("value"),
                    F.right(F.replace(F.array_join(F.slice(parts, F.lit(1), k - 1), ""), F.lit("\u0002"), F.lit("")), F.lit(before)).alias("before"),
                    F.left(F.replace(F.substring(rest, end + 1, F.length(rest)), F.lit("\u0002"), F.lit("")), F.lit(after)).alias("after"),
                )

            return bound(F.array_join(F.slice(parts, k, F.size(parts)), ""), cut)

        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), at)).otherwise(F.array().cast("array<struct<value:string,before:string,after:string>>"))

    return bound(F.split(F.regexp_replace(c, f"({pattern})", "\u0001$1\u0002"), "\u0001"), found)


def said(c: Column, phrases: list[str]) -> Column:
    """The first of the phrases, in their order, with an occurrence that isn't negated in the 30 characters before."""

    def stands(phrase: Column) -> Column:
        parts = F.split(c, phrase)
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1))
        # most texts hold no phrase and need not be split
        return F.contains(c, phrase) & (F.size(parts) > 1) & F.exists(places, lambda k: ~F.right(F.array_join(F.slice(parts, F.lit(1), k), "#"), F.lit(30)).rlike(NEGATION))

    return F.try_element_at(F.filter(F.array(*map(F.lit, phrases)), stands), F.lit(1))


def numbers(found: Column, group: str) -> Column:
    """Largest number among matches that no unit of time or dose follows."""
    good = F.filter(found, lambda m: ~m["after"].rlike(rf"^\s*{NOT_A_MEASURE}"))
    return F.array_max(F.transform(good, lambda m: F.regexp_extract(m["value"], group, 1).cast("double")))


def extracted(text: Column) -> Column:
    """struct<fever, fever_felt, pain, pain_worse, dyspnoea, bleeding> by rules; null where nothing was said."""
    return bound(bound(digits(fold(F.coalesce(text, F.lit("")))), own), _extracted)


def _fever(t: Column) -> Column:
    found = matches(t, r"\b(?:3[5-9]|4[0-3])(?:[.,]\d)?\b", 28, 22)
    found = F.filter(found, lambda m: m["before"].rlike(FEVER_BEFORE) | m["after"].rlike(r"^\s*(?:grados|°|de fiebre|de temperatura)"))
    found = F.transform(found, lambda m: F.struct(F.replace(m["value"], F.lit(","), F.lit(".")).alias("value"), m["before"].alias("before"), m["after"].alias("after")))
    return numbers(found, r"^(.*)$")


def _extracted(t: Column) -> Column:
    # each match ends with its number, so that what follows the number tells its unit
    pain = F.greatest(
        numbers(matches(t, r"(?:dolor|duele|molestia|adolorid\w*)\D{0,18}?\b(?:10|[0-9])\b", 0, 22), r"(\d+)$"),
        numbers(matches(t, r"\b(?:10|[0-9])(?=\s*(?:de|sobre|/)\s*(?:10|diez))", 0, 22), r"^(\d+)"),
        numbers(matches(t, r"\b(?:10|[0-9])\b(?=\D{0,12}?(?:de dolor|en la escala))", 0, 22), r"^(\d+)"),
    )
    no = r"(?:sin|no|nada de|ni)\s+(?:\w+\s+){0,2}"
    yes = lambda c: F.when(c, F.lit(True))
    felt = t.rlike(r"fiebre|calentur|destempl|febril|acalorad") & ~t.rlike(no + r"(?:fiebre|calentur|temperatura)")
    return bound(_fever(t), lambda fever: F.struct(
        fever.alias("fever"),
        yes(felt & fever.isNull()).alias("fever_felt"),
        pain.alias("pain"),
        yes(t.rlike(r"empeor|aument|va subiendo|mas fuerte|cada vez peor")).alias("pain_worse"),
        yes(t.rlike(r"no puedo respirar|me falta el (?:aire|aliento)|me ahogo|dificultad para respirar|me sofoco|me fatigo|sin resuello|me agito|me canso (?:mucho|al camin)")).alias("dyspnoea"),
        yes(t.rlike(r"\bsangr\w*|\bhemorragi\w*") & ~t.rlike(no + r"(?:sangr|hemorragi)")).alias("bleeding"),
    ))
