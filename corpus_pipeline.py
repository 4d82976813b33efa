"""The corpus pipeline: toxicity, n-gram Jaccard join, substring dedup, benchmark decontamination, best-fit packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm import decontam, jaccard, packing, substring, toxicity
from tamiz.llm.store import returned, saved, small
from tamiz.session import table

#: Columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key() -> Column:
    """Tells the rows of a repeated or missing doc_id apart: the id as text and a hash of the text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))


def _judged(docs: DataFrame) -> DataFrame:
    """docs as an operator that judges texts alone shall see them: each row under its key, so that rows that share an id,
    or have none, are judged by their own text."""
    return docs.select(_key().alias("doc_id"), "text")


def _keys(judged: DataFrame) -> DataFrame:
    """The keys of judged rows, written."""
    return saved(judged.select(F.col("doc_id").alias("key")).distinct(), "gone")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that have the keys in gone."""
    return docs.withColumn("key", _key()).join(small(gone, gone.count(), 1_000_000), "key", "left_anti").select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says label 1 go; learned from docs and labels.

    Each row is judged by its own text, also where ids repeat or are null. Null and empty texts have no neighbours and
    stay unless most such labelled texts are toxic; very long texts are read whole. Equal texts get equal decisions.
    Empty docs give an empty table; other columns than those of documents are dropped.
    """
    scored = toxicity.score(_judged(docs), table(spark, sf_dir, "labels"), fit_on=docs)
    gone = _keys(scored.where("predicted = 1"))
    returned(scored)
    return _without(docs, gone)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one of smallest doc_id stays; of rows that share that id the one whose text has
    the smallest hash; a row without id only if none has one.

    Null and empty texts have no shingles and link with nothing; they stay, but a row that repeats id and text of
    another goes. Rows whose id is null or repeated are linked under a number of their own, so different texts under one
    id are different documents. Very long texts are compared whole. Empty docs give an empty table.
    """
    docs = docs.select(*COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long"))
    lowest = docs.agg(F.least(F.coalesce(F.min("doc_id"), F.lit(0)), F.lit(0))).first()[0]
    again = saved(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    repeated = small(again, again.count())
    once = docs.where("doc_id is not null").join(repeated, "doc_id", "left_anti").select(*COLUMNS).withColumn("row", F.col("doc_id"))
    odd = saved(docs.where("doc_id is null").unionByName(docs.join(repeated, "doc_id", "left_semi").select(*COLUMNS)), "odd")
    # numbers below all ids; the table is written, so a task that runs again counts alike
    odd = odd.withColumn("row", F.lit(lowest - 1) - F.monotonically_increasing_id())
    rows = once.unionByName(odd)
    linked = saved(jaccard.link(rows.select(F.col("row").alias("doc_id"), "text")), "linked")
    # a table of ids and hashes alone
    named = rows.select(F.col("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    odd_ones = named.where(F.col("row") < lowest)
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("hash"), F.col("row"))
    grouped = linked.where("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id"))
    several = saved(grouped.groupBy("component_id").count().where("count > 1").select("component_id"), "several")
    members = grouped.join(small(several, several.count()), "component_id").join(odd_ones, "row", "left").withColumn("id", F.when(F.col("row") < lowest, F.col("id")).otherwise(F.col("row")))
    members = saved(members.select("component_id", "row", place.alias("place")), "members")
    stays = members.groupBy("component_id").agg(F.min("place")["row"].alias("row"))
    gone = members.select("row").join(stays.select("row"), "row", "left_anti")
    # rows without shingles that repeat id and text of another
    empty = odd_ones.where("id is not null").join(linked.where("n_shingles = 0").select(F.col("doc_id").alias("row")), "row", "left_semi")
    spare = empty.join(empty.groupBy("id", "hash").agg(F.min("row").alias("row")), "row", "left_anti").select("row")
    gone = saved(gone.unionByName(spare), "gone")
    return rows.join(small(gone, gone.count()), "row", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller doc_id holds too are cut; what has no word left goes.

    A row is cut by its own text; rows that share an id don't cut one another, and a row without id neither cuts nor is
    cut. Null, empty and short texts stay as they are; very long ones are searched whole. Empty docs give an empty table.
    """
    docs = docs.select(*COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long"))
    _, spans = substring.repeats(docs)
    cut = substring.kept_words(docs, spans)
    cut = cut.where("kept <> ''").select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))
    return substring.untouched(docs.withColumn("own", F.xxhash64("text")), spans).select(*COLUMNS).unionByName(cut)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Each row is judged by its own text, also where ids repeat or are null. Null and empty texts hold no window and stay;
    very long ones are searched whole. An empty benchmark drops nothing; empty docs give an empty table.
    """
    judged = decontam.decontaminate(_judged(docs), table(spark, sf_dir, "benchmark"))
    return _without(docs, _keys(judged.where("contaminated")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their places in sequences; null texts are empty documents, ids are not read as keys."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: A classifier and a tokenizer are no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
