"""Bounded samples of labelled documents, and the logistic calibration that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most bytes of text in a sample, and of one text in it, which is learned from whole.
SAMPLE_BYTES, TEXT_BYTES = 48_000_000, 2_000_000


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null without doc_id."""
    return F.crc32(doc_id.cast("string")) % folds


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(remainder(doc_id, folds) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, seed: int = 0, folds: int = 5, most: int = SAMPLE_BYTES, longest: int = TEXT_BYTES) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most `rows` labelled rows of each label and as many drawn without regard to it.

    Only rows outside the held-out fold, in the order of a hash of doc_id, so alike on every run. Texts are whole, of
    `longest` bytes at most; rows are drawn until their texts come to `most` bytes. Ids are chosen from the labels alone, and the sizes and hashes of their
    texts say which rows are fetched, so no more than 3 * rows texts reach the driver, however often an id is repeated.
    Null labels, ids and texts are left out; of repeated labels of an id a 1 counts, of its texts the shortest.
    """
    usable = labels.select("doc_id", F.col(target).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), folds) != 0))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("draw", F.xxhash64("doc_id", F.lit(seed)))
    drawn = [usable.where(F.col("label") == y).orderBy("draw", "doc_id").limit(rows) for y in (0, 1)] + [usable.orderBy("draw", "doc_id").limit(rows)]
    ids = drawn[0].union(drawn[1]).union(drawn[2]).select("doc_id", "label", "draw").distinct()
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    first = F.min(F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash")))
    sizes = texts.groupBy("doc_id", "draw").agg(first.alias("first")).select("doc_id", "draw", "first.*").where(F.col("size") <= longest)
    # one task adds up the sizes: 3 * rows numbers
    running = F.sum("size").over(Window.orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = sizes.withColumn("upto", running).where(F.col("upto") <= most).select("doc_id", "hash")
    found = texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return sorted((r["doc_id"], r["text"], r["label"]) for r in found)


def label_rate(labels: DataFrame, target: str, folds: int = 5) -> float:
    """Share of label 1 among all labelled rows outside the held-out fold, kept off 0 and 1."""
    usable = labels.where(F.col(target).isin(0, 1) & (remainder(F.col("doc_id"), folds) != 0))
    rate = usable.agg(F.avg(F.col(target).cast("double"))).first()[0]
    return min(max(rate or 0.0, 1e-6), 1 - 1e-6)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the first is the constant) of a logistic regression, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def base_rate(y: list[int]) -> float:
    """Share of label 1, shrunk; 0.25 where there is nothing to learn from."""
    return (sum(y) + 0.5) / (len(y) + 2)
