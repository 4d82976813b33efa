"""Source divergence audit: how far apart the word distributions of a language's sources are, by dense term-block matrices.

Words are counted by lang, term and source in the tasks that read texts. Document frequencies are summed first, so that only the
counts of terms that a language keeps are dealt by source, and these terms to blocks. Of a block a task makes a dense int64 tile, groups by terms, turns counts into
scaled probabilities, and adds up |p - q| for all pairs of groups by broadcasting the tile against itself; it keeps the partial
pair matrix, and a heap of the terms that each group uses most above its language, over all blocks that it sees. Partial
matrices are summed and heaps merged. Groups come in tiles too, so that a task never holds more than two tiles of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.store import dropped, lean, saved, small
from tamiz.llm.words import LONG, frees, sliced, texts
from tamiz.operators.retrieval import top

#: A term is kept in a language by so many of its documents; what is added to each count; what probabilities are scaled by.
DOCUMENTS, SMOOTH, SCALE = 30, 5, 1000**3
#: Terms that a group's report shows at most.
TERMS = 50
#: Groups of a tile, terms of a block, blocks that one task sees of two tiles, numbers in a broadcast at most.
GROUPS, BLOCK, STRETCH, CELLS = 128, 512, 4, 2_000_000
#: Counts of a term that one task adds up, but for what a hash deals unevenly.
TOGETHER = 64
#: Kept terms that are broadcast at most (some 20 MB); more are joined by a shuffle.
KEPT = 200_000
#: Bytes that counted words may take before a task passes them on, and what one takes in two counters, short as it may be.
HELD, ENTRY = 80_000_000, 300
#: Bytes that are in no term, and lower case for A-Z.
FOLD = bytes(32 if b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if b < 91 else b for b in range(256))


#: What a source held of a term: the source's hash and the occurrences.
CELL = np.dtype([("source", "<i8"), ("n", "<i8")])


def slices(cells: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Cells as one binary value for each stretch between ends."""
    raw = np.ascontiguousarray(cells).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends * CELL.itemsize, np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All cells of a binary column, and the row of each."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), CELL), np.repeat(np.arange(len(values)), [len(v) // CELL.itemsize for v in values])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, n, held, sources): documents, occurrences, and cells of each source, as a task has counted them each
    time that they take HELD bytes and at its end. The empty term of a lang counts documents and names the sources."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    named = pa.list_(pa.struct([("source", pa.string()), ("hash", pa.int64())]))

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[Counter, dict[str, Counter]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (docs, sources) in counts.items():
                terms, place = list(docs), {t: i for i, t in enumerate(docs)}
                hashes = np.array([xxhash.xxh3_64_intdigest(s.encode()) for s in sources], np.uint64).view(np.int64)
                at = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in sources.values()])
                cells = np.empty(len(at), CELL)
                cells["n"] = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in sources.values()])
                cells["source"] = np.repeat(hashes, [len(c) for c in sources.values()])
                cells = cells[np.argsort(at, kind="stable")]
                ends = np.r_[0, np.cumsum(np.bincount(at, minlength=len(terms)))]
                names = [[{"source": s, "hash": h} for s, h in zip(sources, hashes.tolist(), strict=True)] if t == b"" else None for t in terms]
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array(np.add.reduceat(cells["n"], ends[:-1])), slices(cells, ends), pa.array(names, named)]
                whole = pa.RecordBatch.from_arrays(columns, ["lang", "term", "docs", "n", "held", "sources"])
                yield from (whole.slice(i, 20_000) for i in range(0, len(terms), 20_000))

        for part in sliced(batches):
            for lang, source, raw in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts(part.column("text")), strict=True):
                docs, sources = counts.setdefault(lang, (Counter(), {}))
                n = sources.setdefault(source, Counter())
                before = len(n) + len(docs)
                here = Counter(raw.translate(FOLD).split())
                here[b""] = 1  # the document itself
                n.update(here)
                docs.update(here.keys())
                size += (len(n) + len(docs) - before) * ENTRY + sum(len(w) for w in here if len(w) > LONG)
                if size > HELD:
                    yield from out()
                    counts.clear()
                    size = 0
        yield from out()

    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, "lang string, term string, docs long, n long, held binary, sources array<struct<source string, hash long>>")


def _new(terms: pa.Array) -> np.ndarray:
    """Where another term begins among rows in the order of terms."""
    return np.flatnonzero(np.r_[True, terms[1:].to_numpy(zero_copy_only=False) != terms[:-1].to_numpy(zero_copy_only=False)])


def merged(rows: DataFrame) -> DataFrame:
    """(lang, block, tile, tiles, term, total, held): one row for each term and tile of sources, of rows (lang, block, tiles, term, total,
    held) in the order of lang, block and term."""

    def one(t: pa.Table) -> pa.RecordBatch:
        new = _new(t.column("term").combine_chunks())
        cells, row = cells_of(t.column("held"))
        at = np.searchsorted(new, row, "right") - 1
        tiles = t.column("tiles").to_numpy()[row]
        order = np.lexsort((cells["source"], cells["source"] % tiles, at))
        cells, at, tiles = cells[order], at[order], tiles[order]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (cells["source"][1:] != cells["source"][:-1])])
        whole = cells[first].copy()
        whole["n"] = np.add.reduceat(cells["n"], first)
        at, tile = at[first], whole["source"] % tiles[first]
        ends = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (tile[1:] != tile[:-1]), True])
        names = ("lang", "block", "tiles", "term", "total")
        mine = pa.array(new[at[ends[:-1]]])
        columns = {c: t.column(c).combine_chunks().take(mine) for c in names} | {"tile": pa.array(tile[ends[:-1]].astype(np.int32)), "held": slices(whole, ends)}
        return pa.RecordBatch.from_arrays([columns[c] for c in ORDER], ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            now = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if now.num_rows:
                last = int(_new(now.column("term").combine_chunks())[-1])  # a term may go on in the next batch
                if last:
                    yield one(now.slice(0, last))
                rest = now.slice(last)
        if rest is not None and rest.num_rows:
            yield one(rest)

    return rows.mapInArrow(run, "lang string, block long, tile int, tiles long, term string, total long, held binary")


ORDER = ["lang", "block", "tile", "tiles", "term", "total", "held"]


def _sums(cells: DataFrame) -> DataFrame:
    """(lang, hash, sum): occurrences of kept terms in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, row = cells_of(b.column("held"))
            langs = b.column("lang").dictionary_encode()
            key = np.rec.fromarrays([langs.indices.to_numpy()[row], cells["source"]], names="lang,source")
            each, at = np.unique(key, return_inverse=True)
            total = np.zeros(len(each), np.int64)
            np.add.at(total, at, cells["n"])
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(each["lang"])), pa.array(each["source"]), pa.array(total)], ["lang", "hash", "sum"])

    return cells.select("lang", "held").mapInArrow(run, "lang string, hash long, sum long").groupBy("lang", "hash").agg(F.sum("sum").alias("sum"))


def scaled(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), by long division in thousands: no product is beyond a long."""
    below = total + SMOOTH * terms
    whole, rest = np.divmod(counts + SMOOTH, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + more
    return 1 + whole


def audit(docs: DataFrame, documents: int = DOCUMENTS, most: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text), for each (lang, source) that occurs.

    Part `pair` has each other source of the lang, with the sum of |p - q| over the lang's terms, all ranks. Part `term` has the
    terms that a group holds and whose p is above the lang's, by the difference, `most` ranks. Terms are runs of letters
    A-Z in either case and of characters beyond ASCII; a lang keeps those in at least `documents` of its documents.

    Null lang, source and text are read as ''. A group without terms has counts of 0, and a lang without kept terms
    values of 0. Ties go by item. Repeated rows count each; other columns are not read; no documents give no rows.
    """
    spark = lean(docs)
    counts = saved(counted(docs), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = saved(kept.where(F.col("docs") >= documents).select("lang", "term", "total"), "terms")
    groups = saved(counts.where("term = ''").select("lang", F.explode("sources").alias("s")).select("lang", "s.source", "s.hash").distinct(), "groups")
    # hashes of a lang's sources differ, or no source could be told by its own
    assert groups.groupBy("lang", "hash").count().where("count > 1").isEmpty()
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS).alias("tiles"))
    langs = saved(sizes.join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all")), "lang", "left").na.fill(0), "langs")
    blocks = kept.join(langs, "lang").select("lang", "term", "total", "tiles", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / BLOCK)).alias("block"))
    # of all that was counted only what a lang keeps moves on
    held = counts.where("term <> ''").select("lang", "term", "held").join(small(blocks, kept.count(), KEPT), ["lang", "term"])
    cells = held.select("lang", "block", "tiles", "term", "total", "held")
    # a term has a row for each file of counts at most: so many of a block meet in a task, and what comes of them meets again
    parts = -(-len(counts.inputFiles()) // TOGETHER)
    while parts > 1:
        salt = F.pmod(F.xxhash64("held"), F.lit(parts))
        cells = merged(cells.repartition("lang", "block", salt).sortWithinPartitions("lang", "block", "term")).drop("tile").select(*cells.columns)
        parts = -(-parts // TOGETHER)
    cells = saved(merged(cells.repartition("lang", "block").sortWithinPartitions("lang", "block", "term")), "cells")
    dropped(counts)
    # tiles of groups, with what each group's counts come to
    every = groups.join(langs, "lang").join(_sums(cells), ["lang", "hash"], "left").na.fill(0, ["sum"])
    tile = F.pmod("hash", F.col("tiles")).cast("int").alias("tile")
    tiles = saved(every.groupBy("lang", "terms", "all", tile).agg(F.sort_array(F.collect_list(F.struct("hash", "sum"))).alias("of")), "tiles")
    a, b = (tiles.select("lang", F.col("tile").alias(x), F.col("of").alias(f"of_{x}"), *more) for x, more in (("a", ("terms", "all")), ("b", ())))
    stretches = F.sequence(F.lit(0), F.floor((F.ceil(F.col("terms") / BLOCK) - 1) / STRETCH).cast("int"))
    pairs = a.join(b, "lang").where("a <= b").withColumn("stretch", F.explode(F.when(F.col("terms") > 0, stretches).otherwise(F.array(F.lit(0)))))
    # a tile's terms go to each pair of tiles that it is in
    numbers = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1), lambda k: F.struct(F.least("tile", k).alias("a"), F.greatest("tile", k).alias("b")))).alias("to")
    dealt = cells.select("lang", "block", "term", "total", "held", numbers).select("lang", "to.a", "to.b", (F.col("block") / STRETCH).cast("int").alias("stretch"), "block", "term", "total", "held")
    key = ["lang", "a", "b", "stretch"]
    rows = pairs.unionByName(dealt, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("block"), "term")
    found = saved(rows.select(*key, "block", "term", "total", "held", "terms", "all", "of_a", "of_b").mapInArrow(_tasks(most), "lang string, hash long, other long, term string, value long"), "found")
    number = groups.select("lang", F.col("hash").alias("other"), F.col("source").alias("item"))
    apart = found.where("term is null").groupBy("lang", "hash", "other").agg(F.sum("value").alias("value"))
    # each pair was computed once
    apart = apart.unionByName(apart.select("lang", F.col("other").alias("hash"), F.col("hash").alias("other"), "value")).join(number, ["lang", "other"])
    out = [(apart, "pair", None), (found.where("term is not null").withColumn("item", F.col("term")), "term", most)]
    reports = [_ranked(df.select("lang", "hash", F.lit(part).alias("part"), "item", "value"), k) for df, part, k in out]
    return reports[0].unionByName(reports[1]).join(groups, ["lang", "hash"]).select("lang", "source", "part", "item", "value", "rank")


def _ranked(df: DataFrame, most: int | None) -> DataFrame:
    df, order = df.withColumn("list", F.struct("lang", "hash")), (F.desc("value"), F.col("item"))
    if most is None:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(*order)))
    return top(df, most, *order, by="list")


def _tasks(most: int):
    """For pairs of tiles, each with its groups first and then its terms' counts: partial pair sums and each group's heap."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, None
        for b in batches:
            first = b.column("of_a").is_valid().to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(first).tolist()
            for start, stop in zip([0, *heads], [*heads, b.num_rows], strict=True):
                begins = start < stop and first[start]
                if begins:
                    if tile:
                        yield tile.found()
                    at = b.slice(start, 1).to_pylist()[0]
                    tile = _Tile(at, most)
                rest = b.slice(start + begins, stop - start - begins)
                if rest.num_rows:
                    tile.take(rest)
        if tile:
            yield tile.found()

    return run


class _Tile:
    """Pair sums of two tiles of groups, which can be the same one, and the heaps of its groups."""

    def __init__(self, of: dict, most: int):
        self.lang, self.terms, self.all, self.most = of["lang"], of["terms"], of["all"], most
        self.own = of["a"] == of["b"]
        # in the order of their hashes
        self.ids = [np.array([x["hash"] for x in of[c]], np.int64) for c in ("of_a", "of_b")]
        self.sums = [np.array([x["sum"] for x in of[c]], np.int64) for c in ("of_a", "of_b")]
        self.pairs = np.zeros((len(self.ids[0]), len(self.ids[1])), np.int64)
        self.heaps: list[list[tuple[int, bytes]]] = [[] for _ in self.ids[0]]
        self.rest: pa.Table | None = None
        # terms that no group of the tiles holds come in no row: the task of the first stretch takes all terms for such
        self.unseen = self.terms if of["stretch"] == 0 else 0

    def take(self, rows: pa.RecordBatch) -> None:
        """Rows in the order of block and term; a block's last term may go on in the next batch."""
        now = pa.Table.from_batches([rows.select(["term", "total", "held"])])
        now = now if self.rest is None else pa.concat_tables([self.rest, now])
        new = _new(now.column("term").combine_chunks())
        whole = (len(new) - 1) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self.block(now.slice(new[i], new[i + BLOCK] - new[i]), new[i : i + BLOCK] - new[i])
        self.rest = now.slice(new[whole])

    def block(self, rows: pa.Table, new: np.ndarray) -> None:
        """rows of whole terms, which begin at new: a dense tile for either side."""
        self.unseen -= len(new)
        cells, row = cells_of(rows.column("held"))
        column = np.searchsorted(new, row, "right") - 1
        p = []
        for ids, sums in zip(self.ids, self.sums, strict=True):
            tile = np.zeros((len(ids), len(new)), np.int64)
            place = np.minimum(np.searchsorted(ids, cells["source"]), len(ids) - 1)
            mine = ids[place] == cells["source"]
            tile[place[mine], column[mine]] = cells["n"][mine]
            p.append((tile, scaled(tile, sums[:, None], self.terms)))
        step = max(1, CELLS // max(1, self.pairs.size))
        for at in range(0, len(new), step):
            x, y = p[0][1][:, at : at + step], p[1][1][:, at : at + step]
            self.pairs += np.abs(x[:, None, :] - y[None, :, :]).sum(2)
        if self.own:
            q = scaled(rows.column("total").to_numpy()[new], np.int64(self.all), self.terms)
            self.above(rows.column("term").combine_chunks().take(pa.array(new)).to_pylist(), p[0][0], p[0][1] - q[None, :])

    def above(self, terms: list[str], counts: np.ndarray, f: np.ndarray) -> None:
        raw = [t.encode() for t in terms]
        for i, heap in enumerate(self.heaps):
            at = np.flatnonzero((counts[i] > 0) & (f[i] > 0))
            if len(heap) >= self.most:
                at = at[f[i, at] >= -heap[-1][0]]
            if len(at):
                heap += [(-int(f[i, k]), raw[k]) for k in at.tolist()]
                heap.sort()
                del heap[self.most :]

    def found(self) -> pa.RecordBatch:
        if self.rest is not None:
            new = _new(self.rest.column("term").combine_chunks())
            for i in range(0, len(new), BLOCK):
                end = new[i + BLOCK] if i + BLOCK < len(new) else self.rest.num_rows
                self.block(self.rest.slice(new[i], end - new[i]), new[i : i + BLOCK] - new[i])
        if self.terms:  # and each task takes those that it saw off again
            x, y = (scaled(np.int64(0), sums, self.terms) for sums in self.sums)
            self.pairs += self.unseen * np.abs(x[:, None] - y[None, :])
        i, j = np.nonzero(np.triu(np.ones(self.pairs.shape, bool), 1) if self.own else np.ones(self.pairs.shape, bool))
        said = [(self.ids[0][k], -v, t.decode()) for k, heap in enumerate(self.heaps) for v, t in heap]
        g = np.r_[self.ids[0][i], np.array([x[0] for x in said], np.int64)]
        value = np.r_[self.pairs[i, j], np.array([x[1] for x in said], np.int64)]
        other = pa.concat_arrays([pa.array(self.ids[1][j]), pa.nulls(len(said), pa.int64())])
        term = pa.concat_arrays([pa.nulls(len(i), pa.string()), pa.array([x[2] for x in said], pa.string())])
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(g), pa.string()), pa.array(g), other, term, pa.array(value)], ["lang", "hash", "other", "term", "value"])
