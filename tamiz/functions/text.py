"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the retrieval tokenizer.
STOP_ES = """a al algo como con de del desde donde dos el ella ellos en entre era eran es esa ese eso esta estas este estos fue ha han hasta hay la las le les lo los mas me mi mientras muy no nos o os otra otro para pero poco por porque que quien se ser si sin sobre su sus te tiene tienen un una uno unos y ya""".split()
STOP_EN = """a an and are as at be by for from has have in is it its of on or that the this to was were will with""".split()
# Function words that tell the language.
ES_HINTS = [" de ", " la ", " el ", " que ", " los ", " para ", " con ", " del "]
EN_HINTS = [" the ", " of ", " and ", " with ", " for ", " that ", " this "]
# Words that mark a document as written for patients.
PATIENT_MARKS = ["plan de cuidado", "para el paciente", "del paciente", "instructivo", "instructions", "recomendaciones", "guia para", "guía para", "cuidados en casa", "en casa", "patient", "educacion", "educación", "que debe saber", "qué debe saber", "alta"]
# Keywords of each scenario; ties go to the first.
SCENARIOS = {
    "apendicectomia": ["apendicitis", "apendicectom", "appendicitis", "appendectomy", "appendix"],
    "colecistectomia": ["colecist", "vesícula", "vesicula biliar", "cholecyst", "gallbladder", "biliar"],
    "colectomia": ["colectom", "colorrectal", "colorectal", "colon", "rectal"],
    "mastectomia": ["mastectom", "mama", "breast", "seno", "cuello uterino", "cervical", "cervix", "cérvix"],
    "reemplazo_articular": ["cadera", "rodilla", "articular", "artroplast", "hip", "knee", "joint replacement", "arthroplasty"],
}
# Names of sections without content.
TOC_NAMES = ["contenido", "contenidos", "tabla de contenido", "indice", "índice", "index", "table of contents", "contents", "references", "referencias", "bibliografia", "bibliografía"]

ACCENTED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"
# combining marks U+0300..U+036F, for text that arrives decomposed
MARKS = r"[\x{300}-\x{36f}]"


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), MARKS, "")


def tokens(c: Column, stop: list[str] | None = None) -> Column:
    """Words of two or more letters or digits, folded, without stop words."""
    stop = sorted({*STOP_ES, *STOP_EN}) if stop is None else stop
    words = F.split(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop) if stop else F.length(w) > 1)


def occurrences(c: Column, word: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def language(c: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    es, en = (sum((occurrences(low, w) for w in hints), F.lit(0)) for hints in (ES_HINTS, EN_HINTS))
    return F.when(es >= en, "es").otherwise("en")


def scenario(title: Column, text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The scenario whose keywords occur most in the title and the first 5000 characters; without any, general."""
    keywords = keywords or SCENARIOS
    hay = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.left(F.coalesce(text, F.lit("")), F.lit(5000))))
    scores = {name: sum((occurrences(hay, k) for k in words), F.lit(0)) for name, words in keywords.items()}
    best = F.greatest(F.lit(0), *scores.values())
    out = F.when(best == 0, "general")
    for name, score in scores.items():
        out = out.when(score == best, name)
    return out


def title_of(file_name: Column) -> Column:
    """A title from a file's stem."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[^.]*$", "")
    return F.left(F.trim(F.translate(stem, "_-", "  ")), F.lit(150))


def content_id(content: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.left(F.sha2(content, 256), F.lit(16))


def fingerprint(c: Column) -> Column:
    """The first 300 characters without white space, in lower case."""
    return F.lower(F.left(F.regexp_replace(c, r"\s+", ""), F.lit(300)))


def for_patients(title: Column) -> Column:
    return F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(PATIENT_MARKS))


def is_toc(name: Column, text: Column) -> Column:
    """A table of contents or a bibliography, by its name or by dotted leaders in over 30 % of at least 8 lines."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    dotted = F.filter(lines, lambda x: x.rlike(r"\.{4,}\s*\d+\s*$"))
    named = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\.+$", "").isin(*TOC_NAMES)
    return named | ((F.size(lines) >= 8) & (F.size(dotted) / F.size(lines) > 0.3))


def sentences(c: Column) -> Column:
    """Split after . ! ? and white space, and before a line that starts with a capital, a bullet or a dash."""
    marked = F.regexp_replace(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), r"\n([A-ZÁÉÍÓÚÑ•-])", "\u0001$1")
    # F.trim itself has a second parameter, which transform would give the place of a sentence as the characters to trim
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def window(text: Column, hit: Column, most: int = 1200) -> Column:
    """At most `most` characters of a text around the start of a passage that matched."""
    at = F.when(F.length(hit) > 0, F.position(F.left(hit, F.lit(80)), text) - 1).otherwise(F.lit(-1))
    start = F.greatest(F.lit(0), at - most // 4)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, F.lit(most)), F.lit("…"))
    return F.when(F.length(text) <= most, text).when(at < 0, F.left(text, F.lit(most))).otherwise(cut)
