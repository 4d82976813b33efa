"""Exact search for the largest inner products by multi-resolution segment statistics.

A vector is cut into segments; of each its mean and its deviation from it are kept. Within a segment of n components
x.y <= n * (mean(x) * mean(y) + deviation(x) * deviation(y)), so the sum over segments bounds an inner product from above,
just as it bounds |x - y|**2 = |x|**2 + |y|**2 - 2 x.y from below. Shorter segments bound more tightly: blocks are judged by
the ranges of their coarsest statistics, the vectors of those that are left by finer and finer ones, and survivors exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm import integers
from tamiz.llm.store import dropped, lean, saved
from tamiz.llm.words import frees
from tamiz.operators.retrieval import top

#: Segments of a vector at each resolution, from coarse to fine (0: as many as make segments of two components); those that
#: blocks are judged and ordered by.
LEVELS, COARSE = (4, 16, 0), 4
#: Queries in a block, of which so many are compared at once; blocks of vectors that one task compares with a block of queries.
QUERIES, AT_ONCE, STRETCH = 4096, 512, 64
#: Share by which bounds are raised against rounding.
SLACK = 1e-9


def edges(dim: int, segments: int) -> np.ndarray:
    """Where segments begin: as many as asked, of equal length but for rounding, none empty."""
    segments = max(1, min(segments or -(-dim // 2), dim))
    return np.unique(np.arange(segments) * dim // segments)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means, then deviations, of each row's segments, times the root of a segment's length, so that their products add up."""
    if not x.shape[1]:
        return np.zeros((len(x), 2))
    at = edges(x.shape[1], segments)
    n = np.diff(np.r_[at, x.shape[1]])
    x = x.astype(np.float64)
    mean = np.add.reduceat(x, at, axis=1) / n
    apart = x - np.repeat(mean, n, axis=1)
    return np.c_[mean * np.sqrt(n), np.sqrt(np.add.reduceat(apart * apart, at, axis=1))]


def _lists(x: np.ndarray) -> pa.Array:
    return pa.array([x.tolist()], pa.list_(pa.float64()))


def _block(t: pa.Table) -> dict[str, pa.Array]:
    """A block's vectors in the order of their ids, and the ranges of their coarse statistics."""
    t = t.sort_by("vec_id")
    x = integers.read(t.column("raw").to_pylist(), t.column("dim")[0].as_py())
    s = statistics(x, COARSE)
    longs = {name: pa.array([t.column(c).to_numpy().tobytes()]) for name, c in (("ids", "vec_id"), ("rows", "row"))}
    return {**longs, "xs": pa.array([integers.packed(x)]), "low": _lists(s.min(0)), "high": _lists(s.max(0)), "norm": pa.array([_norms(x).max()])}


BLOCKS = "ids binary, rows binary, xs binary, low array<double>, high array<double>, norm double"


def _norms(x: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x.astype(np.float64), axis=1)


def _placed(rows: DataFrame) -> DataFrame:
    """rows with a cell: the coarse statistics of a vector's direction, in steps of a quarter, which neighbours share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, raws, cells = b.column("dim").to_pylist(), b.column("raw").to_pylist(), []
            for dim, raw in zip(dims, raws, strict=True):
                x = integers.read([raw], dim)
                cells.append(np.floor(4 * statistics(x, COARSE)[0] / max(1.0, _norms(x)[0])).astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], [*b.schema.names, "cell"])

    return rows.mapInArrow(run, "vec_id long, dim int, raw binary, cell array<int>")


def _bound(a: str, b: str) -> Column:
    """The largest product of statistics that two ranges allow: no two vectors of the blocks have a larger inner product."""
    ends = lambda k: F.zip_with(F.col(f"{a}_{k}"), F.arrays_zip(F.col(f"{b}_low").alias("l"), F.col(f"{b}_high").alias("h")), lambda x, y: F.greatest(x * y["l"], x * y["h"]))
    most = F.zip_with(ends("low"), ends("high"), lambda x, y: F.greatest(x, y))
    return F.aggregate(most, SLACK * (F.col(f"{a}_norm") * F.col(f"{b}_norm") + 1), lambda s, x: s + x)


def _search(pairs: DataFrame, cut: DataFrame, asked: DataFrame, k: int, slices: int, levels: tuple[int, ...]) -> DataFrame:
    """(q, query_id, vec_id, score, pairs, exact): the best of each task, with how many pairs it was given and how many it
    computed exactly in the block's first row. pairs (dim, q, seq, bound) says which blocks meet; a task has a block of
    queries and a stretch of the blocks that it meets, those with the largest bounds first."""
    work = pairs.withColumn("stretch", F.pmod(F.xxhash64("seq"), F.lit(slices)))
    data = work.join(cut.select("dim", "seq", "ids", "rows", "xs", "low", "high"), ["dim", "seq"])
    heads = work.select("dim", "q", "stretch").distinct().join(asked.select("dim", F.col("seq").alias("q"), "ids", "rows", "xs", "low", "high"), ["dim", "q"]).withColumns({"bound": F.lit(None).cast("double"), "seq": F.lit(None).cast("long")})
    key = ["dim", "q", "stretch"]
    rows = data.unionByName(heads, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, F.col("bound").desc_nulls_first(), "seq")

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, search = None, None
        for b in batches:
            for i, (dim, q, stretch, bound) in enumerate(zip(*(b.column(c).to_pylist() for c in (*key, "bound")), strict=True)):
                ids, own, xs = (b.column(c)[i].as_py() for c in ("ids", "rows", "xs"))
                ids, own = np.frombuffer(ids, np.int64), np.frombuffer(own, np.int64)
                x = integers.unpacked(xs, len(ids), dim)
                if (dim, q, stretch) != at:
                    assert bound is None
                    if search:
                        yield search.found()
                    at, search = (dim, q, stretch), _Search(ids, own, x, k, levels)
                else:
                    search.meet(ids, own, x, *(np.array(b.column(c)[i].as_py()) for c in ("low", "high")))
        if search:
            yield search.found()

    return rows.mapInArrow(run, "q long, query_id long, vec_id long, score long, pairs long, exact long")


class _Search:
    """A block of queries and what was found for them so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, k: int, levels: tuple[int, ...]):
        self.ids, self.rows, self.x, self.levels = ids, rows, x, levels
        self.best = integers.Best(len(ids), k)
        self.coarse, self.fine = statistics(x, COARSE), [statistics(x, n) for n in levels]
        self.slack = SLACK * (_norms(x) + 1)
        self.pairs = self.exact = 0

    def meet(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.pairs += len(self.ids) * len(ids)
        slack = self.slack * (_norms(x).max() + 1)
        least = self.best.least() - slack
        alive = np.flatnonzero(np.maximum(self.coarse * low, self.coarse * high).sum(1) >= least)
        if not len(alive):
            return
        fine = None
        for start in range(0, len(alive), AT_ONCE):
            q = alive[start : start + AT_ONCE]
            near = np.ones((len(q), len(ids)), bool)
            if np.isfinite(least[q]).any():
                fine = fine or [statistics(x, n) for n in self.levels]
                for mine, theirs in zip(self.fine, fine, strict=True):
                    # of the vectors and queries that are left
                    i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                    if not len(i):
                        break
                    near[np.ix_(i, j)] &= mine[q[i]] @ theirs[j].T >= least[q[i]][:, None]
            i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(i):
                continue
            near = near[np.ix_(i, j)]
            self.exact += int(near.sum())
            if near.sum() * 16 < near.size:  # few pairs: their own products
                a, b = np.nonzero(near)
                scores = np.zeros(near.shape, np.int64)
                scores[a, b] = (self.x[q[i[a]]] * x[j[b]]).sum(1)
            else:
                scores = integers.dot(self.x[q[i]], x[j])
            self.best.offer(q[i], scores, ids[j], near & (self.rows[q[i]][:, None] != rows[j][None, :]))

    def found(self) -> pa.RecordBatch:
        i, score, who = self.best.lists()
        first = np.zeros((2, len(i) + 1), np.int64)
        first[:, 0] = self.pairs, self.exact
        none = pa.nulls(1, pa.int64())
        columns = [pa.concat_arrays([none, pa.array(c)]) for c in (self.rows[i], self.ids[i], who, score)]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, first)], ["q", "query_id", "vec_id", "score", "pairs", "exact"])


def search(vectors: DataFrame, asked: Column, k: int = 5, scale: int = 256, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product of each row of vectors (vec_id, embedding)
    for which `asked`, a condition on vec_id, holds; ties go to the smaller vec_id.

    A row is a candidate for all queries but its own, also where its vec_id or its vector is repeated; a repeated id has a
    list for each of its rows. Components become floor(scale * x). Vectors that are null or hold null or non-finite
    components, and rows without vec_id, take no part, nor do those whose integer norm is 2**31 or more. Vectors of
    different lengths are not compared; empty ones score 0. Fewer than k candidates give fewer rows, none give none. Other
    columns are not read.

    Vectors are sorted by their coarse statistics and cut into blocks, and so are queries. A block of queries first meets the
    one block of the largest bound; its k-th scores then exclude blocks of smaller bounds, before their data move.
    """
    return best(found(vectors, asked, k, scale, levels), k)


def best(passed: DataFrame, k: int) -> DataFrame:
    ranked = top(passed.where("q is not null").select("q", "query_id", "vec_id", "score"), k, F.desc("score"), F.col("vec_id"), by="q")
    return ranked.select("query_id", "rank", "vec_id", "score")


def found(vectors: DataFrame, asked: Column, k: int = 5, scale: int = 256, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """What search() takes its lists from: a task's best, and one row without a query that tells its pairs."""
    spark = lean(vectors)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a row keeps its number
    base = saved(_placed(integers.quantised(vectors, scale)).withColumn("row", F.monotonically_increasing_id()), "vectors")
    order = ["dim", "cell", "vec_id", "row"]
    cut = saved(integers.blocks(base, order, parts, _block, BLOCKS), "blocks")
    queries = saved(integers.blocks(base.where(asked), order, parts, _block, BLOCKS, QUERIES), "queries")
    dropped(base)
    n = cut.count()
    slices = max(1, -(-n // STRETCH))
    side = lambda df, name, seq: df.select("dim", F.col("seq").alias(seq), *(F.col(c).alias(f"{name}_{c}") for c in ("low", "high", "norm")))
    # ranges of blocks, not vectors: one row for each QUERIES * BLOCK pairs of the stated queries with all vectors
    pairs = saved(side(queries, "a", "q").join(side(cut, "b", "seq"), "dim").select("dim", "q", "seq", _bound("a", "b").alias("bound")), "pairs")
    nearest = top(pairs, 1, F.desc("bound"), F.col("seq"), by="q").drop("rank")
    first = _search(nearest, cut, queries, k, 1, levels).where("q is not null")
    # the weakest k-th score of a block of queries; none where a query has no k candidates yet
    kth = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("kth")).select(F.col("q").alias("row"), F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    owner = integers.owners(queries).withColumnRenamed("seq", "q")
    weakest = owner.join(kth, "row", "left").groupBy("dim", "q").agg(F.min(F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf")))).alias("least"))
    weakest = saved(weakest, "weakest")
    near = pairs.join(weakest, ["dim", "q"]).where("bound >= least").drop("least")
    return _search(near, cut, queries, k, slices, levels)
