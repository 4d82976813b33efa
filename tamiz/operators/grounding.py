"""Extractions held against what was said: fields without a supporting word go, numbers that were said win."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import speech
from tamiz.functions.text import fold

# Words that support a field.
FLAGS = {
    "pain_worse": r"empeor|aument|subiendo|sube|mas fuerte|peor|creciendo",
    "bleeding": r"sangr",
    "dyspnoea": r"respir|ahog|aire|asfixi|alient|fatig|resuell|agitad|jadea|cansancio al camin|me canso|sofoc",
    "vomiting": r"vomit|devolv|trasboc|arroj|guacar|basque",
    "fever_felt": r"fiebre|calentur|temperatura|destempl|febril|caliente|acalorad",
}
FIELDS = {
    "appetite": r"apetito|hambre|desgano|ganas|no he comido|como poc|comer poc|provoca|casi no com|no com[eo] (?:casi )?nada",
    "sleep": r"no duermo|duermo poc|duermo mal|despiert|desvel|insomn|no (?:he )?podido dormir|casi no duermo|trasnoch|dormido mal|no logro dormir|pego el ojo|dando vueltas|no puedo dormir|no poder dormir|no me deja dormir|duermo casi nada",
}
MINIMISES = r"uno aguanta|aguanta uno|yo aguanto|no se preocupe|nada grave|no es nada|ya se (?:me )?pasara|no es para tanto|no quiero molestar|creo que es normal|capaz es normal|es normal (?:de la|del|no mas|con)|uno ya sabe|no me preocupo|no estoy tan mal|tan mal no"
PUS = r"(?:liquid\w*|secre\w*|supura\w*|sale|solt\w*|salien\w*)[^.]{0,25}(?:amarill\w*|verd\w*)|pus|huele (?:feo|mal|maluco)|mal olor|olor feo"
PAIN, FEVER = r"dolor|duele|molest|adolori", r"fiebre|temperatur|calentur|grados|termometr|febril"


def grounded(c: dict[str, Column], text: Column) -> dict[str, Column]:
    """Columns pain, fever, wound, the flags, appetite and sleep as far as the text supports them, with two flags more:
    mentioned (pain without a number) and minimises."""
    t = fold(F.coalesce(text, F.lit("")))
    said = speech.extracted(text)
    out = {name: F.when(t.rlike(pattern) | ~c[name], c[name]) for name, pattern in FLAGS.items()}
    out |= {name: F.when(t.rlike(pattern), c[name]) for name, pattern in FIELDS.items()}
    pain_said = said["pain"]
    out["pain"] = F.when(c["pain"].isNull() | ~t.rlike(PAIN + r"|escala|punzad|arde"), None).when(pain_said.isNotNull(), pain_said).when(c["pain"] >= 5, c["pain"])
    measured = t.rlike(FEVER) & speech.digits(t).rlike(r"\d")
    out["fever"] = F.when(c["fever"].isNotNull() & measured, F.coalesce(said["fever"], c["fever"]))
    pus = F.exists(speech.matches(t, PUS, 30, 0), lambda m: ~m["before"].rlike(speech.NEGATION))
    out["wound"] = F.when(pus & (F.coalesce(c["wound"], F.lit("")) != "abierta"), "secrecion_purulenta").otherwise(c["wound"])
    out["mentioned"] = out["pain"].isNull() & t.rlike(PAIN)
    out["minimises"] = t.rlike(MINIMISES)
    return out
