"""Hard negatives by a block matrix multiply on two dimensions (after SUMMA, van de Geijn and Watts, 1997).

The matrix of scores is anchors times all rows, summed over components. Rows and anchors are cut into blocks, and their
components into chunks; a task multiplies a chunk of a block of anchors with the same chunk of a stretch of blocks of rows. Its
int64 tiles are partial sums: they are shuffled by tile, added, and a task keeps running top lists of all tiles of a block of
anchors that it sees, first of positives, then of the negatives in the window that each positive's score opens.
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

#: Components in a chunk, anchors in a block, blocks of rows that one task multiplies with a block of anchors.
CHUNK, ANCHORS, STRETCH = 32, 512, 16
#: Positives of an anchor, negatives of a positive, and their scores at least and at most, in percent of its score.
POSITIVES, NEGATIVES, WINDOW = 5, 5, (80, 100)


def _block(t: pa.Table) -> dict[str, pa.Array]:
    x = integers.read(t.column("raw").to_pylist(), t.column("dim")[0].as_py())
    labels = t.column("label").combine_chunks()
    longs = {name: pa.array([t.column(c).to_numpy().tobytes()]) for name, c in (("ids", "vec_id"), ("rows", "row"))}
    kind = pa.list_(labels.type)
    return {"labels": pa.array([labels.to_pylist()], kind), "from": labels[:1], "upto": labels[-1:], **longs, "xs": pa.array([integers.packed(x)])}


def _chunks(blocks: DataFrame, chunk: int) -> DataFrame:
    """(dim, seq, chunk, n, xs): each block's vectors, a chunk of their components at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, seq, rows, xs in zip(*(b.column(c).to_pylist() for c in ("dim", "seq", "rows", "xs")), strict=True):
                x = integers.unpacked(xs, len(rows) // 8, dim)
                parts = [integers.packed(x[:, at : at + chunk]) for at in range(0, max(dim, 1), chunk)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * n, pa.int32()), pa.array([seq] * n), pa.array(range(n), pa.int32()), pa.array([len(x)] * n, pa.int32()), pa.array([min(chunk, dim - chunk * i) for i in range(n)], pa.int32()), pa.array(parts)], ["dim", "seq", "chunk", "n", "width", "xs"])

    return blocks.select("dim", "seq", "rows", "xs").mapInArrow(run, "dim int, seq long, chunk int, n int, width int, xs binary")


def _tiles(work: DataFrame, rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(dim, a, seq, tile): partial sums of the tiles that work (dim, a, seq, stretch) names, one for each chunk."""
    data = work.join(rows, ["dim", "seq"])
    heads = work.select("dim", "a", "stretch").distinct().join(anchors.withColumnRenamed("seq", "a"), ["dim", "a"]).withColumn("seq", F.lit(None).cast("long"))
    key = ["dim", "a", "chunk", "stretch"]
    dealt = data.unionByName(heads).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            for i, (dim, a, seq, n, width) in enumerate(zip(*(b.column(c).to_pylist() for c in ("dim", "a", "seq", "n", "width")), strict=True)):
                x = integers.unpacked(b.column("xs")[i].as_py(), n, width)
                if seq is None:
                    own = x
                    continue
                tile = integers.packed(integers.dot(own, x))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([a]), pa.array([seq]), pa.array([tile])], ["dim", "a", "seq", "tile"])

    return dealt.mapInArrow(run, "dim int, a long, seq long, tile binary")


def _same(mine: list, theirs: list) -> np.ndarray:
    """Which labels of two lists are equal."""
    code = {x: i for i, x in enumerate(dict.fromkeys([*mine, *theirs]))}
    return np.array([code[x] for x in mine])[:, None] == np.array([code[x] for x in theirs])[None, :]


def _added(tiles: DataFrame, rows: DataFrame, anchors: DataFrame, slices: int, lists, schema: str) -> DataFrame:
    """Runs the lists that lists(anchors' block) makes over the sums of tiles: each gets meet(block of rows, scores), and
    says found() when a task has seen all its tiles of that block of anchors."""
    part = F.pmod(F.xxhash64("seq"), F.lit(slices)).alias("part")
    key = ["dim", "a", "part"]
    sums = tiles.select("dim", "a", "seq", part, "tile", F.lit(2).alias("kind"))
    named = tiles.select("dim", "a", "seq").distinct()
    theirs = named.join(rows.select("dim", "seq", "ids", "rows", "labels"), ["dim", "seq"]).select("dim", "a", "seq", part, "ids", "rows", "labels", F.lit(1).alias("kind"))
    heads = named.select("dim", "a", part).distinct().join(anchors.withColumnRenamed("seq", "a"), ["dim", "a"]).withColumn("kind", F.lit(0))
    # anchors first, then of each block of rows what it is, then its partial tiles
    dealt = heads.unionByName(theirs, allowMissingColumns=True).unionByName(sums, allowMissingColumns=True)
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("seq"), "kind")

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, block, total = None, None, None
        for b in batches:
            for i, kind in enumerate(b.column("kind").to_pylist()):
                if kind == 2:
                    tile = integers.unpacked(b.column("tile")[i].as_py(), len(running.ids), len(block["ids"]))
                    total = tile if total is None else total + tile
                    continue
                if total is not None:
                    running.meet(block, total)
                    total = None
                of = {c: b.column(c)[i].as_py() for c in b.schema.names if c != "tile"}
                of |= {c: np.frombuffer(of[c], np.int64) for c in ("ids", "rows")}
                if kind == 0:
                    if running is not None:
                        yield running.found()
                    running = lists(of)
                else:
                    block = of
        if total is not None:
            running.meet(block, total)
        if running is not None:
            yield running.found()

    return dealt.mapInArrow(run, schema)


class _Positives:
    """The best rows of each anchor's label."""

    def __init__(self, of: dict, k: int):
        self.of, self.ids, self.best = of, of["ids"], integers.Best(len(of["ids"]), k)

    def meet(self, block: dict, scores: np.ndarray) -> None:
        mask = _same(self.of["labels"], block["labels"]) & (self.of["rows"][:, None] != block["rows"][None, :])
        self.best.offer(np.arange(len(scores)), scores, block["ids"], mask)

    def found(self) -> pa.RecordBatch:
        i, score, who = self.best.lists()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.of["rows"][i], self.ids[i], who, score)], ["anchor", "anchor_id", "positive_id", "positive_score"])


class _Negatives:
    """The best rows of other labels in the window of each positive."""

    def __init__(self, of: dict, k: int, window: tuple[int, int]):
        self.of, self.ids = of, of["ids"]
        place = {r: i for i, r in enumerate(of["rows"].tolist())}
        own = of["positives"]
        self.at = np.array([place[p["anchor"]] for p in own], np.int64)
        scores = [p["positive_score"] for p in own]
        # Python's integers: a percentage of a long needn't be one, and no score is beyond integers.NORM
        most = int(integers.NORM)
        self.low = np.array([max(-most, min(most, -(-window[0] * s // 100))) for s in scores], np.int64)
        self.high = np.array([max(-most, min(most, window[1] * s // 100)) for s in scores], np.int64)
        self.own, self.best = own, integers.Best(len(own), k)

    def meet(self, block: dict, scores: np.ndarray) -> None:
        other = ~_same(self.of["labels"], block["labels"])
        mine = scores[self.at]
        self.best.offer(np.arange(len(mine)), mine, block["ids"], other[self.at] & (mine >= self.low[:, None]) & (mine <= self.high[:, None]))

    def found(self) -> pa.RecordBatch:
        i, score, who = self.best.lists()
        names = ("anchor", "anchor_id", "place", "positive_id", "positive_score")
        return pa.RecordBatch.from_arrays([*(pa.array([self.own[x][c] for x in i.tolist()], pa.int64()) for c in names), pa.array(who), pa.array(score)], [*names, "negative_id", "negative_score"])


def mine(vectors: DataFrame, asked: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = 256, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding).

    Anchors are the rows for which `asked`, a condition on vec_id, holds. An anchor's positives are its first other rows of
    the same label, by integer inner product of floor(scale * x), ties by smaller vec_id; for each of them the first rows
    of other labels whose score is from window[0] to window[1] percent of the positive's. A positive without such rows,
    and an anchor without positives, give no row.

    Rows without vec_id, label or vector, with a null or non-finite component, or an integer norm of 2**31 or more take no part.
    Rows that repeat a vec_id are rows of their own, as positives of one another too, and an anchor of their id has lists of
    its own for each. Vectors of different lengths are not compared. Empty input gives no rows; other columns are not read.
    """
    spark = lean(vectors)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"labels array<{label}>, from {label}, upto {label}, ids binary, rows binary, xs binary"
    # written, so that a row keeps its number
    base = saved(integers.quantised(vectors.where("label is not null"), scale, "label").withColumn("row", F.monotonically_increasing_id()), "vectors")
    order = ["dim", "label", "vec_id", "row"]
    rows = saved(integers.blocks(base, order, parts, _block, schema), "rows")
    anchors = saved(integers.blocks(base.where(asked), order, parts, _block, schema, ANCHORS), "anchors")
    dropped(base)
    row_chunks, anchor_chunks = saved(_chunks(rows, chunk), "chunks"), saved(_chunks(anchors, chunk), "anchor_chunks")
    slices = max(1, -(-rows.count() // STRETCH))
    # blocks alone meet: the stated anchors against all rows. Rows are sorted by label, so most pairs of blocks are of one kind.
    side = lambda df, name: df.select("dim", F.col("seq").alias(name), F.col("from").alias(f"{name}_from"), F.col("upto").alias(f"{name}_upto"))
    met = side(anchors, "a").join(side(rows, "seq"), "dim").withColumn("stretch", F.pmod(F.xxhash64("seq"), F.lit(slices)))
    shared = (F.col("a_from") <= F.col("seq_upto")) & (F.col("seq_from") <= F.col("a_upto"))
    alone = (F.col("a_from") == F.col("a_upto")) & (F.col("seq_from") == F.col("seq_upto")) & (F.col("a_from") == F.col("seq_from"))
    work = ["dim", "a", "seq", "stretch"]
    heads = anchors.select("dim", "seq", "ids", "rows", "labels")
    tiles = saved(_tiles(met.where(shared).select(*work), row_chunks, anchor_chunks), "tiles")
    first = _added(tiles, rows, heads, slices, lambda of: _Positives(of, positives), "anchor long, anchor_id long, positive_id long, positive_score long")
    chosen = saved(top(first, positives, F.desc("positive_score"), F.col("positive_id"), by="anchor", rank="place"), "positives")
    dropped(tiles)
    owner = integers.owners(anchors).withColumnRenamed("row", "anchor")
    # at most ANCHORS * positives of a block of anchors
    windows = chosen.join(owner, "anchor").groupBy("dim", "seq").agg(F.sort_array(F.collect_list(F.struct("anchor", "anchor_id", F.col("place").cast("long").alias("place"), "positive_id", "positive_score"))).alias("positives"))
    windows = saved(heads.join(windows, ["dim", "seq"]), "windows")
    tiles = saved(_tiles(met.where(~alone).join(windows.select("dim", F.col("seq").alias("a")), ["dim", "a"]).select(*work), row_chunks, anchor_chunks), "tiles")
    second = _added(tiles, rows, windows, slices, lambda of: _Negatives(of, negatives, window), "anchor long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = second.withColumn("list", F.struct("anchor", "place"))
    best = top(best, negatives, F.desc("negative_score"), F.col("negative_id"), by="list")
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
