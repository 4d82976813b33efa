"""Words that are like others, by the ratio of their matching parts, without comparing all pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Targets that are broadcast at most.
SMALL = 100_000


def counted_letters(word: Column) -> Column:
    """Each letter of a word with how often it has come so far, so that two words share as many entries as letters."""

    def entry(c: Column, i: Column) -> Column:
        upto = F.substring(word, F.lit(1), i + 1)
        return F.concat(c, (F.length(upto) - F.length(F.replace(upto, c, F.lit("")))).cast("string"))

    return F.transform(F.filter(F.split(word, ""), lambda c: c != ""), entry)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    out, matcher = [], SequenceMatcher(None, autojunk=False)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        matcher.set_seqs(x, y)
        out.append(matcher.ratio())
    return pd.Series(out, dtype=float)


def candidates(words: DataFrame, targets: DataFrame, least: float) -> DataFrame:
    """(word, target) of different words and targets whose ratio may reach `least`, 2 * matching letters over all letters: only
    lengths that allow it meet, and the letters that two words share bound those that match."""
    n = F.length("word")
    near = F.sequence(F.ceil(n * least / (2 - least) - 1e-9).cast("int"), F.floor(n * (2 - least) / least + 1e-9).cast("int"))
    mine = words.select("word").where("word <> ''").distinct().withColumn("letters", counted_letters(F.col("word"))).withColumn("size", F.explode(near))
    theirs = targets.select("target").where("target <> ''").distinct().select("target", F.length("target").alias("size"), counted_letters(F.col("target")).alias("theirs"))
    theirs = F.broadcast(theirs) if targets.count() <= SMALL else theirs
    shared = F.size(F.array_intersect("letters", "theirs"))
    return mine.join(theirs, "size").where(2 * shared >= F.lit(least) * (n + F.col("size")) - 1e-9).select("word", "target")


def similar(words: DataFrame, targets: DataFrame, least: float = 0.8) -> DataFrame:
    """(word, target, ratio) of all different words (word) and targets (target) with a ratio of at least `least`, over 0.

    The ratio is that of the longest matching parts, found again on either side; it is worked out for candidates alone.
    Null and empty words are like none.
    """
    return candidates(words, targets, least).withColumn("ratio", _ratio("word", "target")).where(F.col("ratio") >= least)
