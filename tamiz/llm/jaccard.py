"""N-gram Jaccard join with signature trees.

1. Every document becomes a set of hashed shingles. A link of Jaccard t needs so large an overlap that the shingles
   of smallest hash (a prefix of each set) must share some, so documents whose prefix holds too few shingles that
   any other prefix holds have no link. That count is exact, over all documents.
2. The rest, one of each group of equal sets, meet in groups by shared prefix shingle. A first look compares each
   with one pivot per group; components of those links need no further comparison inside.
3. Groups that still hold several components are searched by signature trees: nodes hold OR-combined bitmaps of the
   shingles and size ranges, and a traversal of two trees drops node pairs whose largest possible overlap is too
   small. Pairs left over are compared by their whole sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.graph import components
from tamiz.llm.store import dropped, lean, saved, small
from tamiz.llm.words import LOWER, Hashes, frees, mixed, sliced, texts, windows

#: Words in a shingle; least Jaccard similarity in hundredths.
SHINGLE, PERCENT = 5, 75
#: Bytes of text for each part of the shared-shingle count; documents of one side of a tree search; bits of a signature.
PART_BYTES, BLOCK, BITS = 32_000_000, 256, 2048
#: Smallest-hash shingles by which documents find their pivots.
PIVOTS = 3
#: One in so many shingles more than the least prefix is looked at, so that a shared passage alone does not make a candidate.
EXTRA = 4
#: Shingles that more candidates than this hold come last in the order that prefixes are taken in.
HOT = 64


def shingle_set(text: bytes | None, hashes: Hashes, k: int = SHINGLE) -> np.ndarray:
    """Distinct shingles, by hash; a text of fewer than k words is one shingle."""
    words = text.translate(LOWER).split() if text else []
    return np.unique(windows(hashes.of(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def least(n: int, percent: int = PERCENT) -> int:
    """The smallest overlap that a set of n can have with a linked one, and the smallest size of such a set."""
    return -(-n * percent // 100)


def planes(x: np.ndarray) -> bytes:
    """Little-endian numbers byte plane by byte plane, which block compression shortens."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


ROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("part", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("known", pa.binary())])


def _read(docs: DataFrame, parts: int, k: int, percent: int) -> DataFrame:
    """One row for each document (n, key of its set), and rows of prefix shingles with their owners for each part.

    A shingle that more than two documents of a batch have is known to be shared: two owners go on, for the count,
    and the others are counted here. So a shingle of a third of all documents weighs no more than two in a batch.
    """

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for number, b in enumerate(sliced(batches)):
            ids = b.column("doc_id").to_pylist()
            sizes, keys, prefixes, owners = [], [], [], []
            for i, text in enumerate(texts(b.column("text"))):
                s = shingle_set(text, hashes, k)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s) and ids[i] is not None:
                    take = min(len(s), len(s) - least(len(s), percent) + max(1, len(s) // EXTRA))
                    prefixes.append(s[:take])
                    owners.append(np.full(take, ids[i], np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n": sizes, "key": keys, "part": [None] * len(ids), "keys": [None] * len(ids), "owners": [None] * len(ids), "known": [None] * len(ids)}, ROW)
            if not prefixes:
                continue
            tokens, owner = np.concatenate(prefixes), np.concatenate(owners)
            place = (((tokens & np.uint64(0xFFFFFFFF)) * np.uint64(parts)) & ~np.uint64(0xFFFFFFFF)) | (tokens >> np.uint64(32))
            order = np.argsort(place, kind="stable")
            place, owner = place[order], owner[order]
            third = np.zeros(len(place), bool)
            third[2:] = place[2:] == place[:-2]
            out = {name: [] for name in ROW.names}
            if third.any():
                found, count = np.unique(owner[third], return_counts=True)
                out["part"].append(number % parts), out["keys"].append(None), out["owners"].append(planes(found)), out["known"].append(planes(count.astype(np.int64)))
                place, owner = place[~third], owner[~third]
            part = (place >> np.uint64(32)).astype(np.int64)
            for p in np.unique(part).tolist():
                low, high = np.searchsorted(part, [p, p + 1])
                key = place[low:high].astype(np.uint32)
                out["part"].append(p), out["keys"].append(planes(np.diff(key, prepend=np.uint32(0)))), out["owners"].append(planes(owner[low:high])), out["known"].append(None)
            rows = len(out["part"])
            yield pa.RecordBatch.from_pydict(out | {n: [None] * rows for n in ("doc_id", "n", "key")}, ROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, key binary, part int, keys binary, owners binary, known binary")


def _shared(parts: int):
    """For a part's rows: how many of its shingles each document shares with another one, packed by bucket of documents."""

    def run(table: pa.Table) -> pa.Table:
        ids, counts, keys, owners = [], [], [], []
        for key, owner, known in zip(*(table.column(c).to_pylist() for c in ("keys", "owners", "known")), strict=True):
            if key is None:
                ids.append(unplanes(owner, np.int64))
                counts.append(unplanes(known, np.int64))
            else:
                keys.append(np.cumsum(unplanes(key, np.uint32), dtype=np.uint32))
                owners.append(unplanes(owner, np.int64))
        if keys:
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            same = key[1:] == key[:-1]
            found, count = np.unique(owner[np.r_[same, False] | np.r_[False, same]], return_counts=True)
            ids.append(found)
            counts.append(count.astype(np.int64))
        id_, count = np.concatenate(ids), np.concatenate(counts)
        bucket = (mixed(id_.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        id_, count, bucket = id_[order], count[order], bucket[order]
        cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)].tolist() if len(bucket) else [0]
        spans = list(itertools.pairwise(cut))
        return pa.table({"bucket": pa.array([int(bucket[i]) for i, _ in spans], pa.int32()), "ids": pa.array([planes(id_[i:j]) for i, j in spans], pa.binary()), "counts": pa.array([planes(count[i:j]) for i, j in spans], pa.binary())})

    return run


def _summed(table: pa.Table) -> pa.Table:
    """(doc_id, shared) of a bucket: the sums over all parts."""
    ids = np.concatenate([unplanes(x, np.int64) for x in table.column("ids").to_pylist()])
    counts = np.concatenate([unplanes(x, np.int64) for x in table.column("counts").to_pylist()])
    found, place = np.unique(ids, return_inverse=True)
    return pa.table({"doc_id": found, "shared": np.bincount(place, counts, len(found)).astype(np.int64)})


def _sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, p, tokens): whole sets by rising hash, and how many of them are the prefix."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in sliced(batches):
            sets = [shingle_set(t, hashes, k) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([len(s) - least(len(s), percent) + 1 for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "n", "p", "tokens"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, p int, tokens array<long>")


def signature(tokens: np.ndarray, bits: int) -> bytes:
    """A bitmap of a set; bits is a power of two, so that a wider one can be folded into it."""
    at = np.zeros(bits, bool)
    at[tokens % np.uint64(bits)] = True
    return np.packbits(at).tobytes()


def wide(n: int) -> int:
    """Bits of a signature that holds a set of n at one in four bits or fewer."""
    return max(BITS, 1 << (4 * n - 1).bit_length())


def most_overlap(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """The largest possible overlap of two sets, by their signatures."""
    size = min(len(a), len(b))
    x, y = (np.bitwise_or.reduce(np.frombuffer(s, np.uint8).reshape(-1, size)) for s in (a, b))
    one, two, both = (int(np.bitwise_count(z).sum()) for z in (x, y, x & y))
    return min(both + min(n_a - one, n_b - two), n_a, n_b)


def _signatures(sets: DataFrame, widened: bool) -> DataFrame:
    """(doc_id, n, signature), of BITS bits or of as many as the set needs."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [t.values.to_numpy().view(np.uint64) for t in b.column("tokens")]
            made = [signature(t, wide(len(t)) if widened else BITS) for t in all_]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), pa.array(made, pa.binary())], ["doc_id", "n", "signature"])

    return sets.select("doc_id", "n", "tokens").mapInArrow(run, "doc_id long, n long, signature binary")


class SignatureTree:
    """Levels of nodes over documents sorted by size: OR of bitmaps, sizes, most shingles beyond one a bit, component or -1."""

    FAN = 8

    def __init__(self, sizes: np.ndarray, signatures: np.ndarray, component: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        s, c, n = signatures[self.order], component[self.order], sizes[self.order]
        level = (s, n, n, n - np.bitwise_count(s).sum(1, dtype=np.int64), c)
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), self.FAN)
            one = np.minimum.reduceat(level[4], at)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at), np.where(one == np.maximum.reduceat(level[4], at), one, -1))
            self.levels.append(level)


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a link between components: sizes and the largest possible overlap allow it."""
    (s, low, high, over, c), (s2, low2, high2, over2, c2) = a, b
    fits = (100 * high[i] >= percent * low2[j]) & (100 * high2[j] >= percent * low[i]) & ((c[i] != c2[j]) | (c[i] == -1))
    i, j, at = i[fits], j[fits], np.flatnonzero(fits)
    overlap = np.bitwise_count(s[i] & s2[j]).sum(1, dtype=np.int64) + np.minimum(over[i], over2[j])
    overlap = np.minimum(overlap, np.minimum(high[i], high2[j]))
    fits[at[(100 + percent) * overlap < percent * (low[i] + low2[j])]] = False
    return fits


def traverse(a: SignatureTree, b: SignatureTree, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (of a, of b) that the bounds leave, by simultaneous descent of both trees."""
    deep = max(len(a.levels), len(b.levels))
    i = j = np.zeros(1, np.int64)
    for d in range(deep - 1, -1, -1):
        la, lb = a.levels[min(d, len(a.levels) - 1)], b.levels[min(d, len(b.levels) - 1)]
        fits = possible(la, lb, i, j, percent)
        i, j = i[fits], j[fits]
        if d:
            down_a = a.levels[d - 1] if d - 1 < len(a.levels) - 1 else None
            down_b = b.levels[d - 1] if d - 1 < len(b.levels) - 1 else None
            for down, first in ((down_a, True), (down_b, False)):
                if down is not None:
                    x = i if first else j
                    child = (x[:, None] * SignatureTree.FAN + np.arange(SignatureTree.FAN)).ravel()
                    other = np.repeat(j if first else i, SignatureTree.FAN)
                    there = child < len(down[0])
                    i, j = (child[there], other[there]) if first else (other[there], child[there])
            if a is b:
                i, j = i[i <= j], j[i <= j]
    if a is b:
        i, j = i[i < j], j[i < j]
    return a.order[i], b.order[j]


def _search(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs left by the trees of each (token, low, high) group of blocks; rows arrive sorted by group."""

    def group(cols: list[np.ndarray], ids: np.ndarray, sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        low, high, block, n, component = cols
        signatures = np.frombuffer(b"".join(sigs), np.uint64).reshape(len(ids), -1)
        if low[0] == high[0]:
            tree = SignatureTree(n, signatures, component)
            i, j = traverse(tree, tree, percent)
            return ids[i], ids[j]
        x, y = np.flatnonzero(block == low[0]), np.flatnonzero(block == high[0])
        if not len(x) or not len(y):
            return ids[:0], ids[:0]
        i, j = traverse(SignatureTree(n[x], signatures[x], component[x]), SignatureTree(n[y], signatures[y], component[y]), percent)
        return ids[x[i]], ids[y[j]]

    names = ["low", "high", "block", "n", "component"]

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> pa.RecordBatch:
            token, cols = table.column("token").to_numpy(), [table.column(c).to_numpy() for c in names]
            ids, sigs = table.column("doc_id").to_numpy(), table.column("signature").to_pylist()
            new = np.flatnonzero((token[1:] != token[:-1]) | (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            found = [group([c[s:e] for c in cols], ids[s:e], sigs[s:e]) for s, e in zip([0, *new.tolist()], [*new.tolist(), len(token)], strict=True)]
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["u", "v"])

        rest = None  # the last group of a batch may go on in the next one
        for b in batches:
            here = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if here.num_rows:
                end = here.slice(here.num_rows - 1).to_pylist()[0]
                same = np.logical_and.reduce([here.column(c).to_numpy() == end[c] for c in ("token", "low", "high")])
                cut = int(np.argmax(same))
                if cut:
                    yield done(here.slice(0, cut))
                rest = here.slice(cut)
        if rest is not None and rest.num_rows:
            yield done(rest)

    return rows.mapInArrow(run, "u long, v long")


def _compared(pairs: DataFrame, sets: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are linked; those that wide signatures exclude don't fetch their sets."""

    @frees
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_u, n_v, s_u, s_v = (b.column(c).to_pylist() for c in ("n_u", "n_v", "signature_u", "signature_v"))
            fits = [(100 + percent) * most_overlap(x, i, y, j) >= percent * (i + j) for x, i, y, j in zip(s_u, n_u, s_v, n_v, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(fits, pa.bool_()))

    def side(of: DataFrame, x: str) -> DataFrame:
        return of.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in of.columns if c != "doc_id"))

    left = pairs.join(side(signatures, "u"), "u").join(side(signatures, "v"), "v").mapInArrow(bounded, "u long, v long").distinct()
    whole = sets.select("doc_id", "n", "tokens")
    both = F.size(F.array_intersect("tokens_u", "tokens_v"))
    return left.join(side(whole, "u"), "u").join(side(whole, "v"), "v").where((100 + percent) * both >= percent * (F.col("n_u") + F.col("n_v"))).select("u", "v")


def _blocks(count: Column) -> Column:
    return F.ceil(count / BLOCK).cast("int")


def link(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs.

    Null and empty texts have no shingles and no link; their component is their own doc_id. Equal sets are linked. A
    doc_id that isn't a whole number is read as one (cast to long), null where that can't be.
    Repeated rows and rows that share a doc_id are one document to the links; a null doc_id gets the component of an
    equal set, if any, and links nothing. Other columns are not read; empty docs give no rows.
    """
    lean(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))
    read = saved(_read(docs, parts, k, percent), "shingles")
    meta = saved(read.where("part is null").select("doc_id", "n", "key"), "meta")
    by_part = read.where("part is not null").select("part", "keys", "owners", "known").groupBy("part")
    shared = by_part.applyInArrow(_shared(parts), "bucket int, ids binary, counts binary").groupBy("bucket").applyInArrow(_summed, "doc_id long, shared long")
    classes = saved(meta.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    enough = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / EXTRA))
    open_ = saved(classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "n").join(shared, "doc_id").where(F.col("shared") >= enough).select("doc_id").distinct(), "open")
    dropped(read)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(open_, open_.count()), "doc_id", "left_semi")
    # rows that repeat an id: one for each different set, or copies would count as owners of shingles
    again = saved(meta.where("n > 0").join(small(open_, open_.count()), "doc_id", "left_semi").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    repeated = small(again, again.count())
    several = _sets(mine.join(repeated, "doc_id", "left_semi").where("text is not null").distinct(), k, percent).where("n > 0").distinct()
    one = _sets(mine.join(repeated, "doc_id", "left_anti"), k, percent).where("n > 0")
    sets = saved(one.unionByName(several).withColumn("own", F.xxhash64("doc_id", "tokens")), "sets")

    # what is known of each token is written before it is joined, so that Spark can split the rows of a token that many hold
    first = sets.select("doc_id", F.explode(F.expr(f"slice(tokens, 1, least(p, {PIVOTS}))")).alias("token"))
    tops = saved(first.groupBy("token").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("top")).where("u < top").select("token", "u"), "tops")
    pivots = first.join(tops, "token")
    pairs = pivots.where("u <> doc_id").select("u", F.col("doc_id").alias("v")).distinct()
    signatures = saved(_signatures(sets, True), "signatures")
    near = saved(_compared(pairs, sets, signatures, percent), "near")
    joined = saved(components(near), "joined")

    # prefixes anew, by (count if over HOT, hash): common passages link nobody who has enough rarer shingles
    lower = sets.select(F.explode(F.expr("slice(tokens, 1, cast(ceil(n / 2) as int))")).alias("token"))
    hot = saved(lower.groupBy("token").count().where(F.col("count") > HOT), "hot")
    last = sets.select("doc_id", "own", F.explode("tokens").alias("token")).join(small(hot, hot.count()), "token").groupBy("doc_id", "own").agg(F.sort_array(F.collect_list(F.struct("count", "token")))["token"].alias("hot"))
    known = sets.join(last, ["doc_id", "own"], "left").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    order = F.when(F.col("hot").isNull(), F.col("tokens")).otherwise(F.concat(F.array_except("tokens", "hot"), "hot"))
    known = known.withColumn("ordered", order)
    prefix = F.expr("slice(ordered, 1, p)")
    entries = known.select("doc_id", "own", "n", F.coalesce("component", "doc_id").alias("component"), F.explode(prefix).alias("token"))
    # tokens that stand for the same documents are searched once
    who = F.bit_xor(F.xxhash64("doc_id", "own")).alias("h1"), F.bit_xor(F.xxhash64("doc_id", "own", F.lit(1))).alias("h2")
    mixed = entries.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("size"), *who).where("c1 < c2")
    mixed = saved(mixed.groupBy("size", "h1", "h2").agg(F.min("token").alias("token")).select("token", "size"), "mixed")
    left = entries.drop("own").join(mixed, "token").withColumn("blocks", _blocks(F.col("size"))).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "n", "component", "doc_id").join(_signatures(sets, False), ["doc_id", "n"])
    found = _search(left.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high"), percent)
    links = near.unionByName(_compared(found.distinct(), sets, signatures, percent))
    final = saved(components(links), "components")
    rep = saved(classes.join(final, classes["rep"] == final["node"], "left").select("key", F.coalesce("component", "rep").alias("component_id")), "rep")
    for used in (open_, again, sets, signatures, tops, near, joined, hot, mixed, classes, final):
        dropped(used)
    linked = meta.where("key is not null").join(rep, "key").select("doc_id", "n", "component_id")
    alone = meta.where("key is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
