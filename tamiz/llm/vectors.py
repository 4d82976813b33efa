"""Near-duplicate vectors by an epsilon grid order join (Boehm et al., 2001).

Unit vectors with cosine of at least c lie within eps = sqrt(2 - 2c) of each other, and so do their projections on
the leading principal axes. Vectors are sorted by the cells, eps wide, of those projections; the sorted sequence is
cut into blocks, and intervals of blocks are joined from the whole sequence downwards: a pair of intervals whose
bounding boxes are more than eps apart is skipped with all below it. Blocks left over are compared by a matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.graph import components
from tamiz.llm.store import dropped, lean, saved
from tamiz.llm.words import frees

#: Least cosine; vectors in a block; principal axes used; children of an interval, as a power of two.
COSINE, BLOCK, AXES, FAN = 0.93, 256, 16, 4
#: Neighbouring blocks that travel together, as a power of two at most, and bytes of their vectors as doubles at most.
TILE, TILE_BYTES = 4, 32_000_000
#: Tiles of the sequence that one task compares with a tile, as a power of two.
STRETCH = 6


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest magnitude, as doubles, so that no sum of squares over- or underflows."""
    x = x.astype(np.float64)
    return x / np.abs(x).max(axis=-1, keepdims=True)


def _valid(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, label, dim, key, raw): raw bytes of usable vectors and their hash, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, keys, raws = [], [], []
            for i, label, v in zip(b.column("vec_id").is_valid().to_pylist(), b.column("label").is_valid().to_pylist(), b.column("embedding"), strict=True):
                good = i and label and v.is_valid and len(v.values) and not v.values.null_count
                if good:
                    x = v.values.to_numpy()
                    good = bool(np.isfinite(x).all() and x.any())
                dims.append(len(x) if good else None)
                raws.append(x.tobytes() if good else None)
                keys.append(xxhash.xxh3_128_digest(raws[-1]) if good else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "label", "dim", "key", "raw"])

    return vectors.mapInArrow(run, f"vec_id long, label {kind}, dim int, key binary, raw binary")


def units(raws: list[bytes] | bytes, kind: type, rows: int) -> np.ndarray:
    """Unit vectors of raw ones."""
    x = scaled(np.frombuffer(raws if isinstance(raws, bytes) else b"".join(raws), kind).reshape(rows, -1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _axes(classes: DataFrame, kind: type, axes: int) -> dict[int, np.ndarray]:
    """Leading principal axes of the unit vectors of each dimension, from sums over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            dim = b.column("dim").to_numpy()
            raws = b.column("raw").to_pylist()
            for d in np.unique(dim).tolist():
                mine = np.flatnonzero(dim == d)
                x = units([raws[i] for i in mine], kind, len(mine))
                x = np.c_[x, np.ones(len(x))]
                total[d] = total.get(d, 0) + x.T @ x
        for d, s in total.items():
            i, j = (a.ravel() for a in np.indices(s.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(i.size, d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s.ravel())], ["dim", "i", "j", "s"])

    sums = classes.select("dim", "raw").mapInArrow(run, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    out = {}
    for d, part in sums.toPandas().groupby("dim"):  # dim squared numbers, whatever the rows
        s = np.zeros((d + 1, d + 1))
        s[part["i"], part["j"]] = part["s"]
        mean = s[:d, d] / s[d, d]
        out[int(d)] = np.linalg.eigh(s[:d, :d] / s[d, d] - np.outer(mean, mean))[1][:, ::-1][:, :axes]
    return out


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray], eps: float, kind: type, name: str) -> DataFrame:
    """(label, dim, part, n, ids, weights, raws, low0.., high0..): the grid order cut into blocks."""
    most = max(a.shape[1] for a in axes.values())
    shared = classes.sparkSession.sparkContext.broadcast(axes)
    cells, places = [f"cell{k}" for k in range(most)], [f"at{k}" for k in range(most)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, raws = b.column("dim").to_numpy(), b.column("raw").to_pylist()
            at = np.zeros((b.num_rows, most))
            for d in np.unique(dim).tolist():
                rows = np.flatnonzero(dim == d)
                got = units([raws[i] for i in rows], kind, len(rows)) @ shared.value[d]
                at[rows, : got.shape[1]] = got
            cell = np.floor(at / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in cell.T), *(pa.array(c) for c in at.T)], [*b.schema.names, *cells, *places])

    head = f"label {name}, dim int, rep long, weight long, raw binary"
    placed = classes.select("label", "dim", "rep", "weight", "raw").mapInArrow(project, head + "".join(f", {c} int" for c in cells) + "".join(f", {c} double" for c in places))
    order = ["label", "dim", *cells, *places[:1], "rep"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, rest = TaskContext.get().partitionId(), 0, None

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal n
            at = np.stack([t.column(c).to_numpy() for c in places])
            row = [t.column("label")[0].as_py(), t.column("dim")[0].as_py(), part, n, t.column("rep").to_numpy().tobytes(), t.column("weight").to_numpy().tobytes(), b"".join(t.column("raw").to_pylist()), *at.min(1).tolist(), *at.max(1).tolist()]
            n += 1
            kinds = [t.schema.field("label").type, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.float64()] * (2 * most)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["label", "dim", "part", "n", "ids", "weights", "raws", *(f"low{k}" for k in range(most)), *(f"high{k}" for k in range(most))])

        for b in batches:
            here = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            while here.num_rows:
                same = np.array(here.column("label").to_pylist(), object)[:BLOCK], here.column("dim").to_numpy()[:BLOCK]
                other = np.flatnonzero((same[0] != same[0][0]) | (same[1] != same[1][0]))
                end = int(other[0]) if len(other) else BLOCK
                if end > here.num_rows or (end == here.num_rows and end < BLOCK):
                    break  # the block may go on in the next batch
                yield block(here.slice(0, end))
                here = here.slice(end)
            rest = here
        while rest is not None and rest.num_rows:
            label, dim = np.array(rest.column("label").to_pylist(), object), rest.column("dim").to_numpy()
            end = int(np.argmin((label == label[0]) & (dim == dim[0]))) or rest.num_rows
            yield block(rest.slice(0, end))
            rest = rest.slice(end)

    out = f"label {name}, dim int, part int, n int, ids binary, weights binary, raws binary" + "".join(f", low{k} double" for k in range(most)) + "".join(f", high{k} double" for k in range(most))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, out)


def _pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b) with a <= b: numbers of the blocks whose boxes are at most eps apart, by descent from the whole sequence."""
    sides = sorted(c for c in blocks.columns if c.startswith("low"))
    boxes = [*sides, *(c.replace("low", "high") for c in sides)]
    top = blocks.agg(F.max("seq")).first()[0]
    depth = max(1, math.ceil((top + 1).bit_length() / FAN))
    level = blocks.select("label", "dim", "seq", *boxes)

    def at(d: int) -> DataFrame:
        grouped = level.groupBy("label", "dim", F.shiftright("seq", FAN * d).alias("node"))
        return grouped.agg(*(F.min(c).alias(c) for c in sides), *(F.max(c).alias(c) for c in boxes[len(sides) :]))

    def gap(k: str):
        high = k.replace("low", "high")
        apart = F.greatest(F.lit(0.0), F.col(f"b_{k}") - F.col(f"a_{high}"), F.col(f"a_{k}") - F.col(f"b_{high}"))
        return apart * apart

    near = sum((gap(k) for k in sides), F.lit(0.0)) <= eps * eps + 1e-9
    root = at(depth).select("label", "dim", F.col("node").alias("a"))
    pairs = root.withColumn("b", F.col("a"))
    for d in range(depth - 1, -1, -1):
        child = at(d)
        one, two = (child.select("label", "dim", F.shiftright("node", FAN).alias(x), F.col("node").alias(f"{x}_node"), *(F.col(c).alias(f"{x}_{c}") for c in boxes)) for x in "ab")
        pairs = pairs.join(one, ["label", "dim", "a"]).join(two, ["label", "dim", "b"]).where((F.col("a_node") <= F.col("b_node")) & near).select("label", "dim", F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return pairs


def joined(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id reached) that join just what the links (rows a, columns b) join."""
    if np.count_nonzero(links) <= len(a) + len(b):
        i, j = np.nonzero(links)
        return a[i], b[j]
    far = np.iinfo(np.int64).max
    rows, cols = a.copy(), b.copy()
    while True:
        new_cols = np.minimum(cols, np.where(links, rows[:, None], far).min(0))
        new_rows = np.minimum(rows, np.where(links, new_cols[None, :], far).min(1))
        if (new_cols == cols).all() and (new_rows == rows).all():
            return np.r_[a, b], np.r_[rows, cols]
        rows, cols = new_rows, new_cols


def _compare(rows: DataFrame, cosine: float, kind: type) -> DataFrame:
    """(u, v, links): an edge (u, v) or, with null v, links of u.

    Rows come sorted by owner tile, its own blocks first (of which one tile is held); each says which of them it meets.
    """

    def read(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(b.column("ids")[i].as_py(), np.int64)
        return ids, np.frombuffer(b.column("weights")[i].as_py(), np.int64), units(b.column("raws")[i].as_py(), kind, len(ids))

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, own = None, {}
        for b in batches:
            out_u, out_v, out_n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
            keys, seqs, met = (b.column(c).to_pylist() for c in ("owner", "seq", "met"))
            for i, (key, seq, against) in enumerate(zip(keys, seqs, met, strict=True)):
                if against is None:  # a block of the tile
                    if key != tile:
                        tile, own = key, {}
                    own[seq] = read(b, i)
                    continue
                other = own[seq] if b.column("raws")[i].as_py() is None else read(b, i)
                for mine in against:
                    links = own[mine][2] @ other[2].T >= cosine
                    if own[mine] is other:
                        np.fill_diagonal(links, False)
                    if not links.any():
                        continue
                    u, v = joined(links, own[mine][0], other[0])
                    out_u.append(u), out_v.append(v)
                    for who, count in ((own[mine][0], links @ other[1]), (other[0], own[mine][1] @ links))[: 1 if own[mine] is other else 2]:
                        out_n.append((who[count > 0], count[count > 0]))
            u, v = np.concatenate(out_u), np.concatenate(out_v)
            who, count = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in out_n)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[u, who]), pa.concat_arrays([pa.array(v), pa.nulls(len(who), pa.int64())]), pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(count)])], ["u", "v", "links"])

    return rows.mapInArrow(run, "u long, v long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, axes: int = AXES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors (vec_id, label, embedding).

    Only vectors of equal, non-null label and equal length are compared. A vector that is null, empty or zero, or
    holds null or non-finite numbers, links with nothing, and so does a row without vec_id (its component is null and
    it isn't kept). Equal vectors are one class that is compared once; its rows count as linked with one another.
    Rows that repeat a vec_id count as vectors of their own. Numbers other than floats are compared as doubles; other
    columns are not read. Empty input gives no rows.

    Blocks of which a pair may hold links are compared in tiles of neighbouring blocks: a block travels once to each tile
    that it meets, and a task holds one tile and one block.
    """
    if vectors.schema["embedding"].dataType.elementType.simpleString() != "float":
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = np.float64 if vectors.schema["embedding"].dataType.elementType.simpleString() == "double" else np.float32
    name = vectors.schema["label"].dataType.simpleString()
    eps = math.sqrt(2 - 2 * cosine)
    lean(vectors)
    base = saved(_valid(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), name), "vectors")
    alone = base.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    classes = saved(base.where("key is not null").groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("raw").alias("raw")), "classes")
    found = _axes(classes, kind, axes)
    if not found:
        return alone
    cut = saved(_blocks(classes, found, eps, kind, name), "blocks")
    most = cut.agg(F.max("n")).first()[0]
    blocks = cut.withColumn("seq", F.col("part").cast("long") * (1 << (most + 1).bit_length()) + F.col("n"))
    out = saved(_compare(_tiles(blocks, _pairs(blocks, eps), tile_shift(max(len(a) for a in found.values()))), cosine, kind), "links")
    linked = components(out.where("v is not null").select("u", "v"))
    degree = out.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    per_class = classes.join(degree, classes["rep"] == degree["u"], "left").join(linked, classes["rep"] == linked["node"], "left")
    # written, so that Spark can split the rows of a vector that many ids have over several tasks
    per_class = saved(per_class.select("label", "key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "per_class")
    for used in (classes, cut, out):
        dropped(used)
    linked = base.where("key is not null").join(per_class, ["label", "key"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)


def tile_shift(dim: int) -> int:
    """Neighbouring blocks in a tile, as a power of two."""
    return max(0, min(TILE, int(math.log2(max(1, TILE_BYTES // (BLOCK * 8 * dim))))))


def _tiles(blocks: DataFrame, pairs: DataFrame, shift: int) -> DataFrame:
    """(owner, seq, met, ids, weights, raws), sorted by owner, a tile with a stretch of the sequence that it meets: the
    tile's blocks first (met is null), then each block that meets some of them, with their numbers; a block that meets its
    own tile comes without data."""
    tile = lambda c: F.shiftright(F.col(c), shift)
    # either tile of a pair can do the work; its sum's parity says which, so that no tile does more than its share
    turn = F.pmod(tile("a") + tile("b"), F.lit(2)) == 0
    mine, other = F.when(turn, F.col("a")).otherwise(F.col("b")), F.when(turn, F.col("b")).otherwise(F.col("a"))
    work = pairs.select("label", "dim", mine.alias("mine"), other.alias("seq")).withColumns({"tile": tile("mine"), "stretch": F.shiftright("seq", shift + STRETCH)})
    work = work.groupBy("label", "dim", "tile", "stretch", "seq").agg(F.collect_list("mine").alias("met"))
    data = blocks.select("label", "dim", "seq", "ids", "weights", "raws")
    partner = work.join(data, ["label", "dim", "seq"]).withColumns({c: F.when(tile("seq") != F.col("tile"), F.col(c)) for c in ("ids", "weights", "raws")})
    keys = work.select("label", "dim", "tile", "stretch").distinct()
    own = data.withColumn("tile", tile("seq")).join(keys, ["label", "dim", "tile"]).withColumn("met", F.lit(None).cast("array<long>"))
    # label and dim are part of the key: a number can stand for two tiles only where their labels differ
    key = ["label", "dim", "tile", "stretch"]
    rows = own.unionByName(partner).repartition(*key).sortWithinPartitions(*key, F.col("met").isNotNull(), "seq")
    return rows.select(F.struct(*key).alias("owner"), "seq", "met", "ids", "weights", "raws")
