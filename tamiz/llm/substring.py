"""Substring dedup by prefix-partitioned suffix trees of bounded depth.

A repeat matters from 50 words on, so of the suffix tree of all texts only the nodes down to that depth count. The
suffixes are split by prefixes of variable length, and a prefix is made longer only where it still has several
documents below it:

1. Of each 50-word window the 10-word prefix of smallest hash inside it is its anchor; equal windows have equal
   anchors, so windows group by anchor, and only about one position in twenty is one. An anchor with all its
   windows' words (its context) is one entry. Anchors of a single document end here, as leaves.
2. Entries with equal context share all their windows: the smallest doc_id with that context covers them at once.
3. Where an anchor has several contexts, the first document of each context lists its windows by their whole
   50 words: these are the deep internal nodes, and each takes the smallest doc_id below it.

Each step is a grouped minimum with map-side partial results; what is joined to all entries is written first, so that
Spark can split the entries of a passage that many documents hold over several tasks.

This is a sparse suffix tree: suffixes start at anchors alone, and subtrees are told by hashes of their words instead of
sorted suffixes. A suffix for each word would be twenty times the rows, more than the input's size in shuffled data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.store import dropped, lean, saved, small
from tamiz.llm.words import Hashes, frees, mixed, sliced, stretches, texts, windows

#: Words of a repeat; words of an anchor.
WINDOW, PREFIX = 50, 10


def anchors(hashes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, prefix hash, first window, last window) of each anchor of one document."""
    grams = windows(hashes, prefix)
    span = window - prefix + 1
    if len(grams) < span:
        empty = np.empty(0, np.int64)
        return empty, np.empty(0, np.uint64), empty, empty
    # rightmost smallest gram of each window, by doubling: best[i] covers width grams from i
    best, width = np.arange(len(grams)), 1
    while width * 2 <= span:
        left, right = best[: len(best) - width], best[width:]
        best = np.where(grams[right] <= grams[left], right, left)
        width *= 2
    n = len(grams) - span + 1
    left, right = best[:n], best[span - width : span - width + n]
    owner = np.where(grams[right] <= grams[left], right, left)
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    end = np.r_[start[1:], n] - 1
    return owner[start], grams[owner[start]], start, end


def context(hashes: np.ndarray, position: np.ndarray, start: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Hash of all words of an anchor's windows, of their number and of where the anchor lies among them."""
    return stretches(hashes, start, end + window) ^ mixed((position - start).astype(np.uint64))


def packed(first: str, last: str) -> Column:
    """A span of windows as one number."""
    return F.shiftleft(F.col(first).cast("long"), 32).bitwiseOR(F.col(last).cast("long"))


def unpacked(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first, last) of each row's spans; those of a null are empty."""
    at, all_ = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [(all_[i:j] >> 32, all_[i:j] & 0xFFFFFFFF) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def covered(n: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words of windows first..last, for each pair."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last + window, -1)
    return np.cumsum(change[:n]) > 0


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _entries(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(doc_id, own, n_words, kept_sha256, entries): every document with its anchors (prefix, context, first, last)."""
    kind = pa.list_(pa.struct([("prefix", pa.int64()), ("context", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in sliced(batches):
            count, digest, sizes, parts = [], [], [0], []
            for text in texts(b.column("text")):
                words = text.split() if text else []
                count.append(len(words))
                digest.append(_digest(words))
                size = 0
                if len(words) >= window:
                    h = hashes.of(words)
                    position, gram, start, end = anchors(h, window, prefix)
                    parts.append((gram, context(h, position, start, end, window), start, end))
                    size = len(gram)
                sizes.append(size)
            gram, ctx, start, end = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint64 if k < 2 else np.int64) for k in range(4))
            flat = pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("own"), pa.array(count, pa.int64()), pa.array(digest, pa.string()), lists], ["doc_id", "own", "n_words", "kept_sha256", "entries"])

    return docs.mapInArrow(run, "doc_id long, own long, n_words long, kept_sha256 string, entries array<struct<prefix:long,context:long,first:int,last:int>>")


def _nodes(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, own, at, node): the windows first..last of each document's spans, each by its whole words."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in sliced(batches):
            at, row, node = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for i, (text, (first, last)) in enumerate(zip(texts(b.column("text")), unpacked(b.column("spans")), strict=True)):
                all_ = windows(hashes.of(text.split()), window)
                size = last - first + 1
                at.append(np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum()))
                row.append(np.full(len(at[-1]), i))
                node.append(all_[at[-1]])
            rows = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("own").take(rows), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(node).view(np.int64))], ["doc_id", "own", "at", "node"])

    return docs.mapInArrow(run, "doc_id long, own long, at int, node long")


def entries_in(lists: DataFrame) -> int:
    """How many spans the rows hold, and rows: what a broadcast of them weighs goes with both."""
    return lists.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0]


def _own(docs: DataFrame) -> DataFrame:
    """docs with `own`, a hash of the text: it tells the texts of a repeated doc_id apart."""
    return docs.withColumn("own", F.xxhash64("text"))


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, own, n_words, kept_sha256 of all words), and the spans of windows to remove (doc_id, own, spans)."""
    lean(docs)
    texts_ = _own(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    read = saved(_entries(texts_, window, prefix), "suffixes")
    every = saved(read.select("doc_id", "own", "n_words", "kept_sha256"), "every")
    entries = read.where("doc_id is not null").select("doc_id", "own", F.inline("entries"))
    contexts = entries.groupBy("prefix", "context").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    prefixes = contexts.groupBy("prefix").agg(F.min("first_doc").alias("low"), F.max("last_doc").alias("high"), F.count("*").alias("contexts")).where("low < high").select("prefix", "low", "contexts")
    shared = saved(contexts.join(prefixes, "prefix").select("prefix", "context", "first_doc", "low", "contexts"), "shared")
    inner = saved(entries.join(shared, ["prefix", "context"]).select("doc_id", "own", "first", "last", "first_doc", "low", "contexts"), "inner")
    whole = inner.where("doc_id > first_doc").select("doc_id", "own", "first", "last")
    # the first document of a context asks where the anchor has others; a smaller or a larger one may share some windows
    asked = saved(inner.where("doc_id = first_doc and contexts > 1").groupBy("doc_id", "own").agg(F.collect_set(packed("first", "last")).alias("spans")), "asked")
    nodes = saved(_nodes(texts_.join(small(asked, entries_in(asked)), ["doc_id", "own"]), window), "nodes")
    lowest = saved(nodes.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("node", "low"), "lowest")
    deep = nodes.join(lowest, "node").where("doc_id > low").select("doc_id", "own", F.col("at").alias("first"), F.col("at").alias("last"))
    spans = saved(whole.unionByName(deep).groupBy("doc_id", "own").agg(F.collect_set(packed("first", "last")).alias("spans")), "spans")
    for used in (read, shared, inner, asked, nodes, lowest):
        dropped(used)
    return every, spans


def untouched(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, own, ...) that no span is for."""
    ids = spans.select("doc_id", "own")
    return docs.join(small(ids, ids.count()), ["doc_id", "own"], "left_anti")


def kept_words(docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs that have spans, with columns n_words, n_removed, kept (the words left, joined by one space) and kept_sha256."""
    names = docs.columns

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows: tuple[list, ...] = ([], [], [], [])
            for text, (first, last) in zip(texts(b.column("text")), unpacked(b.column("spans")), strict=True):
                words = text.split()
                gone = covered(len(words), first, last, window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                for to, x in zip(rows, (len(words), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()), strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], [*names, "n_words", "n_removed", "kept", "kept_sha256"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    ids = spans.select("doc_id", "own")
    mine = _own(docs).join(small(ids, ids.count()), ["doc_id", "own"], "left_semi")
    return mine.join(small(spans, entries_in(spans)), ["doc_id", "own"]).select(*names, "spans").mapInArrow(run, f"{schema}, n_words long, n_removed long, kept string, kept_sha256 string")


def dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each row of docs.

    A word goes if a window over it also starts in a document of smaller doc_id. Null and empty texts have no words.
    Rows that repeat a doc_id don't remove from one another; each loses what smaller ones hold of its own text. A row
    without doc_id neither removes nor loses words; a doc_id that is no whole number is read as one (cast to long), null
    where that can't be. Other columns are not read.
    """
    every, spans = repeats(docs, window, prefix)
    cut = kept_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), spans, window)
    rest = untouched(every, spans)
    return rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").unionByName(cut.select("doc_id", "n_words", "n_removed", "kept_sha256"))
