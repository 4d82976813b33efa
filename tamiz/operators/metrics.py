"""Latency percentiles, per-call rollups, cost, and agreement of predicted with expected levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.sources.versions import written

#: Values that one task may put in order, and ranges that more of them are cut into at a time.
MOST, RANGES = 1_000_000, 128


def placed(df: DataFrame, value: str, places: dict[str, Column], *by: str) -> DataFrame:
    """(by..., one column for each name): the values at places (from 0, by a column n of the group's size) of each group in order.

    All places go together. While the range that holds one has more than MOST values, it is cut at approximate quantiles of
    its own values, which are then counted exactly, so a range shrinks whatever the values are like; a single value is a
    range by itself. What is left is counted by value and put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    named = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in places.items())))
    none = F.lit(None).cast("double")
    wanted = sizes.select(*by, "n", named.alias("p")).select(*by, "p.*", none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("before"), F.col("n").alias("held"))
    wanted = written(wanted, "places")
    key = [*by, "name"]
    inside = lambda of: rows.join(of, list(by)).where((F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high"))))
    while (wanted.agg(F.max("held")).first()[0] or 0) > MOST:
        wide = wanted.where(F.col("held") > MOST)
        shares = [k / RANGES for k in range(1, RANGES)]
        cuts = inside(wide).groupBy(*key).agg(F.array_distinct(F.percentile_approx("v", shares, 10_000)).alias("cuts"))
        # a value at which the range is cut is a range of its own, so each range loses some values at least
        cell = (2 * F.size(F.filter("cuts", lambda x: x < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")).alias("cell")
        counted = inside(wide).join(cuts, key).groupBy(*key, "place", "before", cell).agg(F.count("*").alias("count"), F.min("v").alias("low"), F.max("v").alias("high"))
        counted = counted.withColumn("upto", F.sum("count").over(Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
        holds = counted.where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("count")))
        # a range of one value is narrow enough
        held = F.when(F.col("low") < F.col("high"), F.col("count")).otherwise(1)
        narrow = holds.select(*key, "place", "low", "high", (F.col("upto") - F.col("count")).alias("before"), held.alias("held"))
        wanted = written(wanted.where(F.col("held") <= MOST).unionByName(narrow), "places")
    order = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = inside(wanted).groupBy(*key, "place", "before", "v").count().withColumn("upto", F.col("before") + F.sum("count").over(order)).where(F.col("upto") > F.col("place"))
    return found.groupBy(*by).agg(*(F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places))


def _nearest_rank(p: float) -> Column:
    return F.least(F.col("n") - 1, F.bround(p * (F.col("n") - 1)))


MIDDLE = {"a": F.floor, "b": F.ceil}


def ranked(df: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """(by..., ranked): the nearest-rank percentile of each group at round-half-even(p * (n - 1))."""
    return placed(df, value, {"ranked": _nearest_rank(p)}, *by)


def median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., median): the mean of a group's one or two middle values."""
    return percentiles(df, value, 0.5, *by).drop("ranked")


def percentiles(df: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """(by..., median, ranked): both in the same passes."""
    middle = {name: half((F.col("n") - 1) / 2) for name, half in MIDDLE.items()}
    found = placed(df, value, {**middle, "ranked": _nearest_rank(p)}, *by)
    return found.select(*by, ((F.col("a") + F.col("b")) / 2).alias("median"), "ranked")


def chosen_cases(cases: DataFrame, layer: str, speaker: str = "paciente", greens: int | None = None, only: list[str] | None = None) -> DataFrame:
    """Evaluation cases (case_id, layer, speaker, level) of a layer and a speaker: all but green ones, the first `greens` of
    those in order of their id (a report's own limit), and of all only the named ones, if any are."""
    mine = cases.where((F.col("layer") == layer) & (F.col("speaker") == speaker))
    mine = mine.where(F.col("case_id").isin(only)) if only else mine
    green = mine.where("level = 'verde'").orderBy("case_id")
    return mine.where("level <> 'verde'").unionByName(green if greens is None else green.limit(greens))


def call_rollup(turns: DataFrame) -> DataFrame:
    """One row: turns, calls, means per turn and per call. Missing counts are 0, a missing latency is left out."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    per_call = turns.groupBy("call_id").agg(F.count("*").alias("turns"), *(F.sum(part(c)).alias(c) for c in ("tokens_in", "tokens_out", "llm_calls", "rag_queries")))
    every, calls = F.greatest(F.sum("turns"), F.lit(1)), F.greatest(F.count("*"), F.lit(1))
    return per_call.agg(
        F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"),
        F.count("*").alias("calls"),
        F.round(F.sum("tokens_in") / every, 1).alias("tokens_in_per_turn"),
        F.round(F.sum("tokens_out") / every, 1).alias("tokens_out_per_turn"),
        F.round(F.sum("llm_calls") / every, 2).alias("model_calls_per_turn"),
        F.round(F.sum("rag_queries") / calls, 2).alias("searches_per_call"),
        F.round(F.sum(F.col("tokens_in") + F.col("tokens_out")) / calls, 1).alias("tokens_per_call"),
    )


def cost(rollup: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Cost of a call under each tariff (name, per million tokens in, out), by the share of tokens in and out."""
    total = F.col("tokens_in_per_turn") + F.col("tokens_out_per_turn")
    share = F.when(total > 0, F.col("tokens_in_per_turn") / total).otherwise(0.0)
    amount = F.col("tokens_per_call") * (share * F.col("usd_in") + (1 - share) * F.col("usd_out")) / 1e6
    return tariffs.join(F.broadcast(rollup)).select("name", F.round(amount, 6).alias("usd_per_call"))


def confusion(df: DataFrame, expected: str, predicted: str, levels: list[str]) -> DataFrame:
    return df.groupBy(expected).pivot(predicted, levels).count().fillna(0)


def misses(df: DataFrame, expected: str, predicted: str, levels: list[str]) -> DataFrame:
    """Cases, those predicted too low, and recall of the highest level."""
    place = lambda c: F.array_position(F.array(*map(F.lit, levels)), F.col(c))
    top = F.col(expected) == levels[-1]
    hit = top & (F.col(predicted) == levels[-1])
    return df.agg(F.count("*").alias("cases"), F.count_if(place(predicted) < place(expected)).alias("too_low"), F.count_if(top).alias("top_cases"), F.round(F.count_if(hit) / F.greatest(F.count_if(top), F.lit(1)), 6).alias("top_recall"))
