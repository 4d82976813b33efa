"""Query expansion between Spanish and English."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions.text import fold

# Spanish terms and their English equivalents.
TERMS = {
    "apendicitis": ["appendicitis"],
    "apendicectomia": ["appendectomy", "appendicectomy"],
    "apendice": ["appendix"],
    "colecistectomia": ["cholecystectomy"],
    "colecistitis": ["cholecystitis"],
    "vesicula": ["gallbladder"],
    "biliar": ["biliary", "bile"],
    "colectomia": ["colectomy"],
    "colorrectal": ["colorectal"],
    "colon": ["colon", "bowel"],
    "mastectomia": ["mastectomy"],
    "mama": ["breast"],
    "seno": ["breast"],
    "cuello uterino": ["cervical", "cervix"],
    "reemplazo articular": ["joint replacement", "arthroplasty"],
    "cadera": ["hip"],
    "rodilla": ["knee"],
    "artroplastia": ["arthroplasty"],
    "herida": ["wound", "incision"],
    "incision": ["incision"],
    "infeccion": ["infection"],
    "fiebre": ["fever", "temperature"],
    "dolor": ["pain"],
    "sangrado": ["bleeding", "hemorrhage"],
    "hemorragia": ["hemorrhage", "bleeding"],
    "secrecion": ["discharge", "drainage", "exudate"],
    "pus": ["pus", "purulent"],
    "enrojecimiento": ["redness", "erythema"],
    "hinchazon": ["swelling", "edema"],
    "inflamacion": ["inflammation"],
    "nausea": ["nausea"],
    "nauseas": ["nausea", "vomiting"],
    "vomito": ["vomiting", "emesis"],
    "estrenimiento": ["constipation"],
    "diarrea": ["diarrhea"],
    "apetito": ["appetite"],
    "medicamento": ["medication", "drug"],
    "antibiotico": ["antibiotic"],
    "analgesico": ["analgesic", "painkiller"],
    "acetaminofen": ["acetaminophen", "paracetamol"],
    "ibuprofeno": ["ibuprofen"],
    "anticoagulante": ["anticoagulant", "blood thinner"],
    "trombosis": ["thrombosis", "dvt"],
    "embolia": ["embolism"],
    "dificultad para respirar": ["shortness of breath", "dyspnea"],
    "respirar": ["breathing", "breath"],
    "mareo": ["dizziness"],
    "desmayo": ["fainting", "syncope"],
    "sutura": ["suture", "stitches"],
    "puntos": ["stitches", "staples"],
    "vendaje": ["dressing", "bandage"],
    "curacion": ["wound care", "dressing change"],
    "banarse": ["shower", "bathing"],
    "ducha": ["shower"],
    "caminar": ["walking", "ambulation"],
    "movilidad": ["mobility", "range of motion"],
    "ejercicio": ["exercise", "physical therapy"],
    "fisioterapia": ["physical therapy", "physiotherapy"],
    "dieta": ["diet", "nutrition"],
    "alimentacion": ["diet", "feeding"],
    "cirugia": ["surgery", "operation"],
    "postoperatorio": ["postoperative", "post-op", "recovery"],
    "recuperacion": ["recovery"],
    "complicacion": ["complication"],
    "alarma": ["warning", "red flag", "alarm"],
    "urgencias": ["emergency", "emergency department"],
    "drenaje": ["drain", "drainage"],
    "seroma": ["seroma"],
    "hematoma": ["hematoma", "bruising"],
    "absceso": ["abscess"],
    "dehiscencia": ["dehiscence", "wound opening"],
    "ileo": ["ileus"],
    "fuga anastomotica": ["anastomotic leak"],
    "estoma": ["stoma", "ostomy"],
    "colostomia": ["colostomy"],
    "linfedema": ["lymphedema"],
    "protesis": ["prosthesis", "implant"],
    "luxacion": ["dislocation"],
    "temperatura": ["temperature", "fever"],
    "escalofrios": ["chills"],
    "orinar": ["urination", "urinary"],
    "estomago": ["stomach", "abdominal"],
    "abdomen": ["abdomen", "abdominal"],
    "barriga": ["abdomen", "belly"],
}


def expanded(query: Column) -> Column:
    """The query with the equivalents of its terms.

    A Spanish term that occurs anywhere adds its English ones that aren't there; else an English one that occurs as
    a word adds the Spanish term. Added terms stand once each, in the order of the table.
    """
    q = fold(query)
    extra = []
    for es, english in TERMS.items():
        missing = F.array_compact(F.array(*(F.when(~F.contains(q, F.lit(e)), e) for e in english)))
        word = "|".join(rf"\b{re.escape(e)}\b" for e in english)
        extra.append(F.when(F.contains(q, F.lit(es)), missing).when(q.rlike(word), F.array(F.lit(es))).otherwise(F.array().cast("array<string>")))
    found = F.array_distinct(F.flatten(F.array(*extra)))
    return F.when(F.size(found) > 0, F.concat_ws(" ", query, F.array_join(found, " "))).otherwise(query)
