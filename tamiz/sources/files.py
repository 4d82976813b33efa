"""Files and logs as DataFrames."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import text as T

#: Uploads of these kinds and at most so many bytes are taken.
KINDS, LARGEST = ("pdf", "txt", "md"), 100 * 1024 * 1024
# Characters that names of files don't keep, and the name of one that has none.
NOT_IN_NAMES, NAMELESS = r"(?U)[^\w .\-áéíóúñüÁÉÍÓÚÑÜ()]", "documento"
#: Longest name.
NAME = 120
#: A turn's log line; keys that are missing are null.
TURN = "call_id string, turno int, ts double, t_speech_end double, t_stt_done double, t_llm_first_token double, t_tts_first_audio double, t_turn_done double, triaje string, tokens_in long, tokens_out long, llm_calls long, rag_queries long, escalado boolean"


def uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, doc_id, bytes, problem, text): each file below a folder with why it can't be taken, if so: kind, size, or empty.

    Names keep letters of any script. Spark's reader passes over empty files; those come from the folder's listing, of which
    the driver keeps the empty ones alone.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    found = found.select("path", "length", "content").unionByName(_empty(spark, path, pattern))
    name = F.left(F.regexp_replace(F.regexp_extract("path", r"[^/]+$", 0), NOT_IN_NAMES, "_"), F.lit(NAME))
    name = F.when(name == "", NAMELESS).otherwise(name)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    problem = F.when(~kind.isin(*KINDS), "kind").when(F.col("length") > LARGEST, "size").when(F.col("length") == 0, "empty")
    text = F.when(problem.isNull() & (kind != "pdf"), F.col("content").cast("string"))
    return found.select(name.alias("file"), T.content_id(F.col("content")).alias("doc_id"), F.col("length").alias("bytes"), problem.alias("problem"), text.alias("text"))


def _empty(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, content) of the empty files below a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    names = []
    while listed.hasNext():
        file = listed.next()
        if file.getLen() == 0 and fnmatch.fnmatchcase(file.getPath().getName(), pattern):
            names.append((file.getPath().toString(),))
    return spark.createDataFrame(names, "path string").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def upload_counts(found: DataFrame) -> DataFrame:
    """(problem, files, bytes) of uploads, with `taken` for those without one."""
    return found.groupBy(F.coalesce("problem", F.lit("taken")).alias("problem")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def vocabulary(spark: SparkSession, path: str) -> frozenset[str]:
    """The words of a file, one to a line; none where there is no file (repairs then go by likeness alone)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return frozenset()
    return frozenset(r["value"] for r in spark.read.text(path).where(F.trim("value") != "").distinct().collect())


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows (turns, calls, alerts) to a log of JSON lines."""
    rows.write.mode("append").json(path)


def turn_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TURN).json(path)


def new_documents(found: DataFrame, known: DataFrame) -> DataFrame:
    """Documents not known by content, each content once."""
    return found.dropDuplicates(["doc_id"]).join(known.select("doc_id").distinct(), "doc_id", "left_anti")
