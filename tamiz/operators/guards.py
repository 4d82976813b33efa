"""What may go on: noise, invented transcripts, stray question marks, limits of inputs, and checks of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import fold

# What a recogniser invents over music or silence (folded, without marks).
INVENTED = ["", "gracias", "subtitulos por la comunidad de amaraorg", "gracias por ver el video", "musica", "silencio", "silence", "subtitulos realizados por la comunidad de amaraorg", "suscribete", "amaraorg", "aplausos", "risas", "ruido", "subtitulado por la comunidad", "mas informacion en wwwamaraorg", "gracias por su atencion"]
# Words that make a question, and clinical data that a stray question mark does not make one.
REAL_QUESTION = r"(?iU)¿|\b(?:qué|cómo|cuándo|dónde|por qué|para qué|puedo|debo|debería|me puedo|es normal|una pregunta)\b"
ASKING = r"(?iU)¿|\b(?:qué|cómo|cuándo|dónde|por qué|para qué|puedo|podría|debo|debería|me puedo|es normal|será normal|quisiera saber|quiero saber|una pregunta|me gustaría saber)\b"
STATED = r"(?iU)\b(?:dolor|fiebre|grados|temperatura|herida|secreci[oó]n|enrojec|hinchaz|camin|apetito|sue[nñ]o|muy bien|normal)\b"
STATED_BUT_ASKED = r"(?iU)\b(?:qué|cuándo|dónde|por qué|para qué|puedo|debo|debería|me puedo|es normal|una pregunta|quisiera|quiero saber|código|cu[aá]l es)\b"
SHORT_ANSWER = r"(?iU)^¿?\s*c[oó]mo?\s+(?:bien|mal|normal|regular)\s*[.?¿]?$"
CLINICAL = r"(?iU)dolor|duele|fiebre|calentura|temperatura|herida|sangr|mareo|vomit|nause|respir|hinch|roj|secre|liquid|pus|comer|apetito|dorm|sueño|camin|mover|pierna|brazo|pecho|cabeza|barriga|estomago|estómago|punto|grado|\?|\d"
# Forms that a reply should not have.
FAMILIAR = r"(?iU)\b(?:tú|tu temperatura|te recomiendo|puedes|debes|tienes)\b"
STOCK = ["gracias por compartir", "puedo ofrecerte|puedo ofrecerle la posibilidad", "y se quede a un lado", "no parece ser un problema grave"]
ALERT = "Por lo que me cuenta"
LOOKING = r"(?iU)perm[ií]tame revisar|d[eé]jeme (?:revisar|consultar)"
#: Least loudness and share of voice (in %) of a turn; most characters a second of speech, shortest time it is counted for.
RMS, VOICE, PER_SECOND, SHORTEST_S = 0.02, 12.0, 25.0, 0.3
#: Least share of said words that a transcript keeps; characters of a transcript that a summary reads; longest short text.
SAME_WORDS, TRANSCRIPT, SHORT_TEXT = 0.25, 4000, 80


def voiced(quality: DataFrame) -> DataFrame:
    """Measured blocks (seconds, rms, voice, ...) that are worth transcribing; ones too short to measure stay."""
    loud = (F.coalesce("rms", F.lit(0.0)) >= RMS) & (F.coalesce("voice", F.lit(0.0)) >= VOICE)
    return quality.where(F.col("rms").isNull() | loud)


def heard(text: Column, seconds: Column) -> Column:
    """A transcript, or nothing where it is invented: a known phrase, only dots, or more than can be said in the time."""
    t = F.trim(F.coalesce(text, F.lit("")))
    known = F.trim(F.regexp_replace(fold(t), r"[^\w ]", "")).isin(INVENTED) | (F.regexp_replace(t, r"[ .…]", "") == "")
    return F.when(known | (F.length(t) / F.greatest(seconds, F.lit(SHORTEST_S)) > PER_SECOND), "").otherwise(t)


def settled(text: Column) -> Column:
    """A statement that a recogniser closed with a question mark gets a full stop."""
    return F.when(text.rlike(r"\?\s*$") & ~text.rlike(REAL_QUESTION), F.concat(F.regexp_replace(text, r"[?\s]+$", ""), F.lit("."))).otherwise(text)


def worth_extracting(text: Column) -> Column:
    return (F.length(text) > 80) | text.rlike(CLINICAL)


def asks(text: Column) -> Column:
    """Whether a patient asks something: not where a datum is stated, nor in a short "cómo bien"."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return ~(t.rlike(STATED) & ~t.rlike(STATED_BUT_ASKED)) & ~t.rlike(SHORT_ANSWER) & t.rlike(ASKING)


def prompt_kind(question: Column, slot: Column, seconds: Column, slots: list[str]) -> Column:
    """Which prompt a recogniser gets: for a confirmation, a slot's own, the long or the short general one, or none."""
    sure = fold(F.coalesce(question, F.lit(""))).rlike("quedo claro|me confirma|entendio|comprendio|de acuerdo")
    return F.when(sure, "confirmation").when(slot.isin(slots), slot).when(seconds >= 1.6, "long").when(seconds >= 0.8, "short").otherwise("none")


def whole_number(value: Column, default: int, least: int = 0, most: int = 200) -> Column:
    """A whole number within limits; the default where it is none."""
    n = value.cast("string").try_cast("double")
    return F.when(n.isNull() | F.isnan(n), default).otherwise(F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), n))).cast("int")


def short_text(value: Column, default: str, most: int = SHORT_TEXT) -> Column:
    return F.when(F.trim(value) != "", F.left(value, F.lit(most))).otherwise(default)


def sample_rate(value: Column, default: int = 48_000) -> Column:
    """A microphone's rate; the default where it is none, or none that can be."""
    n = value.cast("string").try_cast("double")
    return F.when(n.between(8000, 192_000), n.cast("long")).otherwise(default).cast("int")


def last_part(transcript: Column, most: int = TRANSCRIPT) -> Column:
    return F.right(transcript, F.lit(most))


def cited(sources: DataFrame, question: Column, turn: Column) -> DataFrame:
    """(call_id, cited): the sources (call_id, n, doc_id, title, section, page_from, page_to) of an answer as records, in order."""
    record = F.struct("n", "doc_id", "title", "section", F.array("page_from", "page_to").alias("pages"), question.alias("question"), turn.alias("turn"))
    return sources.groupBy("call_id").agg(F.sort_array(F.collect_list(record)).alias("cited"))


def source_block(n: Column, title: Column, section: Column, page_from: Column, page_to: Column, body: Column) -> Column:
    """A source as a model reads it."""
    return F.format_string("[%d] «%s» — sección: %s (págs. %d-%d)\n%s", n, title, section, page_from, page_to, body)


def record(state: DataFrame, *names: str) -> Column:
    """A state as one flat JSON object, without what is not known."""
    return F.to_json(F.struct(*names))


def spurious_search(said: Column, reply: Column) -> Column:
    """Whether a reply says that it looks something up where a datum was stated and nothing asked."""
    return said.rlike(STATED) & ~said.rlike(REAL_QUESTION) & reply.rlike(LOOKING)


def reply_issues(said: Column, transcript: Column, reply: Column) -> Column:
    """What a turn of a test call did wrong: array of sentences."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-záéíóúñü]{3,})"), F.lit(1)))
    mine, got = words(F.coalesce(said, F.lit(""))), words(F.coalesce(transcript, F.lit("")))
    missing = F.coalesce(transcript, F.lit("")) == ""
    other = ~missing & (F.size(mine) > 0) & (F.size(F.array_intersect(mine, got)) < SAME_WORDS * F.size(mine))
    times = lambda word: F.size(F.split(reply, word)) - 1
    found = [
        F.when(missing, "STT vacío o ausente"),
        F.when(other, F.concat(F.lit("STT muy distinto de lo dicho: «"), transcript, F.lit("»"))),
        F.when(reply.rlike(FAMILIAR), "Posible tuteo en respuesta"),
        *(F.when(reply.rlike(f"(?i){p}"), f"Fórmula poco natural: {p}") for p in STOCK),
        F.when(times("¿") > 1, "Más de una pregunta en el turno"),
        F.when(times(ALERT) > 1, "Protocolo de alerta duplicado en el mismo texto"),
        F.when(spurious_search(F.coalesce(said, F.lit("")), F.coalesce(reply, F.lit(""))), F.concat(F.lit("RAG espurio ante dato clínico (posible '?' de ASR): «"), F.left(F.coalesce(transcript, F.lit("")), F.lit(80)), F.lit("»"))),
    ]
    return F.array_compact(F.array(*found))


def battery(calls: DataFrame) -> DataFrame:
    """One row of totals over test calls (ok, issues): calls, passed, failed, and searches where no question was asked."""
    spurious = F.size(F.filter("issues", lambda x: F.contains(x, F.lit("RAG espurio"))))
    return calls.agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"), F.coalesce(F.sum(spurious), F.lit(0)).alias("spurious_searches"))


def issue_counts(calls: DataFrame) -> DataFrame:
    """(issue, calls): how many test calls show each issue, whatever it quotes."""
    kind = F.regexp_replace(F.regexp_replace("issue", r"^T\d+: ", ""), r"[:«].*$", "")
    return calls.select("call_id", F.explode("issues").alias("issue")).select("call_id", kind.alias("issue")).distinct().groupBy(F.trim("issue").alias("issue")).agg(F.count("*").alias("calls"))


def report_lines(calls: DataFrame) -> DataFrame:
    """(n, line): a report as Markdown: totals, the head of its table, then test calls (call_id, name, case, level, ok, issues, seconds)
    in the order of their numbers."""
    dash = F.lit("—")
    issues = F.when(F.size("issues") > 0, F.replace(F.array_join(F.slice("issues", 1, 3), "; "), F.lit("|"), F.lit("/"))).otherwise(dash)
    cells = [F.col("call_id").cast("string"), F.col("name"), F.col("case"), F.coalesce("level", dash), F.when(F.col("ok"), "sí").otherwise("NO"), issues, F.col("seconds").cast("string")]
    rows = calls.select(F.col("call_id").cast("long").alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    sums = calls.agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.round(F.sum("seconds"), 1).alias("seconds"))
    said = [F.format_string("- Pacientes: **%d**", "total"), F.format_string("- OK: **%d** · Fallos: **%d**", F.col("ok"), F.col("total") - F.col("ok")), F.concat(F.lit("- Duración total: **"), F.coalesce(F.col("seconds"), F.lit(0.0)).cast("string"), F.lit(" s**"))]
    head = [*said, F.lit("| # | Paciente | Caso | Triaje | OK | Issues | s |"), F.lit("|---|----------|------|--------|----|--------|---|")]
    top = sums.select(F.posexplode(F.array(*head)).alias("k", "line")).select((F.col("k") - len(head)).cast("long").alias("n"), "line")
    return top.unionByName(rows)


def write_report(calls: DataFrame, path: str) -> None:
    """Test calls as JSON lines, and as a Markdown file; their numbers count from 0 or higher."""
    calls.write.mode("overwrite").json(f"{path}/json")
    report_lines(calls).repartitionByRange(1, "n").sortWithinPartitions("n").select("line").write.mode("overwrite").text(f"{path}/table")
