"""Vectors of integers: made from floating ones, cut into blocks, multiplied exactly, and the best scores of many lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of vectors in a block at most.
BLOCK, BLOCK_BYTES = 512, 2_000_000
#: A squared norm that all scores of two vectors stay under, so that they are longs.
NORM = 2.0**62


def quantised(vectors: DataFrame, scale: int = 256, *more: str) -> DataFrame:
    """(vec_id, more.., dim, raw): floor(scale * x) of each component, as doubles take it, in the narrowest of 2, 4 and 8 bytes.

    Rows without vec_id, without a vector, or with a component that is null, not finite or not finite once scaled are left
    out, and so are vectors whose squared integer norm is 2**62 or more, as scores of them needn't be longs.
    """
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *more, F.col("embedding").cast("array<double>").alias("embedding"))
    wide = wide.where("vec_id is not null and embedding is not null")
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in wide.schema if f.name != "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("embedding")
            dims = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int32)
            with np.errstate(all="ignore"):
                x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                ends = np.cumsum(dims, dtype=np.int64)
                full = np.flatnonzero(dims)
                good, most = np.ones(b.num_rows, bool), np.zeros(b.num_rows)
                if len(full):
                    starts = (ends - dims)[full]
                    squares = np.add.reduceat(x * x, starts)
                    good[full] = np.isfinite(squares) & (squares < NORM)
                    most[full] = np.maximum.reduceat(np.abs(x), starts)
            raws = []
            for i in np.flatnonzero(good).tolist():
                kind = np.int16 if most[i] < 1 << 15 else np.int32 if most[i] < 1 << 31 else np.int64
                raws.append(x[ends[i] - dims[i] : ends[i]].astype(kind).tobytes())
            kept = b.drop_columns(["embedding"]).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(dims[good]), pa.array(raws, pa.binary())], [*kept.schema.names, "dim", "raw"])

    return wide.mapInArrow(run, f"{head}dim int, raw binary")


def read(raws: list[bytes], dim: int) -> np.ndarray:
    """The vectors that raw ones say, as int64 rows."""
    if not dim:
        return np.zeros((len(raws), 0), np.int64)
    sizes = {len(r) for r in raws}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(raws), f"i{sizes.pop() // dim}").reshape(-1, dim).astype(np.int64)
    return np.stack([np.frombuffer(r, f"i{len(r) // dim}").astype(np.int64) for r in raws])


def packed(x: np.ndarray) -> bytes:
    """Integers in the narrowest of 2, 4 and 8 bytes."""
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def unpacked(raw: bytes, rows: int, columns: int) -> np.ndarray:
    return read([raw], rows * columns).reshape(rows, columns)


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact int64 products of the rows of two integer matrices: by floating products where those are exact."""
    if not (x.size and y.size):
        return np.zeros((len(x), len(y)), np.int64)
    if float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def blocks(rows: DataFrame, order: list[Column | str], parts: int, of, schema: str, most: int = BLOCK) -> DataFrame:
    """(dim, seq, what `of` says..): rows (dim, raw, ..) of one dimension in an order, cut into blocks of up to `most` of them.

    `of` turns a table of rows into the columns of schema; seq numbers blocks in their order, with gaps.
    """
    kind = [pa.int32(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, rest = TaskContext.get().partitionId(), 0, None

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal n
            more = of(t)
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([t.column("dim")[0].as_py()], kind[0]), pa.array([(part << 32) + n - 1], kind[1]), *more.values()], ["dim", "seq", *more])

        for b in _then_none(batches):
            here = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            while here is not None and here.num_rows:
                dims = here.column("dim").to_numpy()
                size = max(1, min(most, BLOCK_BYTES // max(1, 8 * int(dims[0]))))
                other = np.flatnonzero(dims[:size] != dims[0])
                end = int(other[0]) if len(other) else size
                if end >= here.num_rows and b is not None and not len(other) and here.num_rows < size:
                    break  # the block may go on in the next batch
                yield block(here.slice(0, end))
                here = here.slice(end)
            rest = here

    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, f"dim int, seq long, {schema}")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def owners(blocks: DataFrame) -> DataFrame:
    """(dim, seq, row): the numbers of the rows that each block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(r, np.int64) for r in b.column("rows").to_pylist()]
            n = [len(r) for r in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in ("dim", "seq")), pa.array(np.concatenate([np.empty(0, np.int64), *rows]))], ["dim", "seq", "row"])

    return blocks.select("dim", "seq", "rows").mapInArrow(run, "dim int, seq long, row long")


class Best:
    """The k best (score, id) of each of n lists: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), np.iinfo(np.int64).min), np.zeros((n, k), np.int64)
        self.held = np.zeros(n, np.int64)

    def least(self) -> np.ndarray:
        """What a score must reach to be among the best, as a double: minus infinity while a list isn't full."""
        return np.where(self.held >= self.k, self.scores[:, -1].astype(np.float64), -np.inf)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> None:
        """scores (one line for each of rows, which are different lists) of ids, where mask holds."""
        full = self.held[rows] >= self.k
        mask = mask & ((scores >= self.scores[rows, -1][:, None]) | ~full[:, None])
        busy = np.flatnonzero(mask.any(1))
        if not len(busy):
            return
        rows, scores, mask = rows[busy], scores[busy], mask[busy]
        if scores.shape[1] > 4 * self.k and mask.sum() > 4 * self.k * len(rows):  # of each line only its own best can count
            low = np.where(mask, scores, np.iinfo(np.int64).min)
            last = np.partition(low, -self.k, axis=1)[:, -self.k][:, None]
            mask &= low >= last
            if mask.sum() > 4 * self.k * len(rows):  # of ties those with the smallest ids
                order = np.argsort(ids, kind="stable")
                ties = (mask & (scores == last))[:, order]
                late = np.empty_like(mask)
                late[:, order] = ties & (np.cumsum(ties, axis=1) > self.k)
                mask &= ~late
        i, j = np.nonzero(mask)
        had_i, had_j = np.nonzero(np.arange(self.k)[None, :] < self.held[rows][:, None])
        at = np.r_[had_i, i]
        score = np.r_[self.scores[rows[had_i], had_j], scores[i, j]]
        who = np.r_[self.ids[rows[had_i], had_j], ids[j]]
        order = np.lexsort((who, -score, at))
        at, score, who = at[order], score[order], who[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k
        at, place = at[kept], place[kept]
        self.scores[rows[at], place], self.ids[rows[at], place] = score[kept], who[kept]
        self.held[rows] = np.minimum(self.k, np.bincount(at, minlength=len(rows)))

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of all that is held."""
        i, j = np.nonzero(np.arange(self.k)[None, :] < self.held[:, None])
        return i, self.scores[i, j], self.ids[i, j]
