"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the word windows of the test items. For each pattern length m a table gives, for every block of two
words that occurs in a pattern, how far the search may shift; any other block lets it skip m - 1 words at once.
Where the shift is zero, the last block selects a bucket of patterns, and direct comparison confirms them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.store import dropped, lean, saved
from tamiz.llm.words import frees, sliced, texts

#: Words in a window of a test item.
WINDOW = 10
#: Most bytes of test items in one set of tables, which take about six times as much; more items are searched in several
#: passes over the documents.
TABLE_BYTES = 16_000_000
#: A-Z in lower case; 0-9, a-z and all but ASCII are parts of words, all else splits them.
FOLD = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else c + 32 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))
NO_ITEMS = hashlib.sha256(b"").hexdigest()


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _slot(a: bytes, b: bytes) -> int:
    return hash(a) * 1000003 ^ hash(b)


class Tables:
    """Shift table and suffix buckets for the patterns of one length: the windows of m words of (number, words) items.

    Blocks share places of the shift table by hash, which can only make a shift smaller. A pattern lies in the bucket of
    its last two and its first two words, as the item and the word it starts at.
    """

    def __init__(self, m: int, items: list[tuple[int, list[bytes]]]):
        self.m, self.numbers, self.words = m, [n for n, _ in items], [w for _, w in items]
        size = 1 << max(12, sum(map(len, self.words)).bit_length() + 2)
        self.mask, self.shift = size - 1, bytearray([m - 1]) * size
        key, item, at = array("I"), array("I"), array("I")
        self.buckets = size // 8 - 1
        for number, words in enumerate(self.words):
            for j in range(1, len(words)):
                place = _slot(words[j - 1], words[j]) & self.mask
                self.shift[place] = min(self.shift[place], max(m - 1 - j, 0))
            for start in range(len(words) - m + 1):
                key.append(self._bucket(words, start))
                item.append(number)
                at.append(start)
        order = np.argsort(np.array(key), kind="stable")
        self.item, self.at = (array("I", np.array(x, np.uint32)[order].tobytes()) for x in (item, at))
        self.first = array("I", np.searchsorted(np.array(key, np.uint32)[order], np.arange(self.buckets + 2)).astype(np.uint32).tobytes())

    def _bucket(self, words: list[bytes], start: int) -> int:
        last = start + self.m - 1
        return (_slot(words[last - (self.m > 1)], words[last]) * 31 ^ _slot(words[start], words[start + (self.m > 1)])) & self.buckets

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of every occurrence."""
        m, n, shift, mask, first = self.m, len(words), self.shift, self.mask, self.first
        at = m - 1
        while at < n:
            step = shift[(hash(words[at - 1]) * 1000003 ^ hash(words[at])) & mask] if m > 1 else 0
            if step:
                at += step
                continue
            start = at - m + 1
            k = self._bucket(words, start)
            if first[k] < first[k + 1]:
                here = words[start : at + 1]
                found = {self.numbers[i] for i, s in zip(self.item[first[k] : first[k + 1]], self.at[first[k] : first[k + 1]], strict=True) if self.words[i][s : s + m] == here}
                if found:
                    yield start, found
            at += 1


def tables(items: list[bytes | None], window: int = WINDOW) -> list[Tables]:
    """Tables of each pattern length; equal words are one object in them."""
    made: dict[int, list[tuple[int, list[bytes]]]] = {}
    known: dict[bytes, bytes] = {}
    for number, text in enumerate(items):
        words = [known.setdefault(w, w) for w in words_of(text)]
        if words:
            made.setdefault(min(window, len(words)), []).append((number, words))
    return [Tables(m, found) for m, found in made.items()]


class Search:
    """Test items as they travel to the executors: texts, and the ids of those that have one; a Python worker makes their
    tables once."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int):
        self.window, self.ids = window, {}
        for item, text in rows:
            self.ids.setdefault(text, set()).update({str(item)} if item is not None else ())
        self.made: list[Tables] | None = None

    def tables(self) -> tuple[list[Tables], list[set[str]]]:
        if self.made is None:
            self.made = tables([t.encode() for t in self.ids], self.window)
        return self.made, list(self.ids.values())


def hits(words: list[bytes], made: list[Tables], mask: np.ndarray | None = None) -> tuple[np.ndarray | None, set[int]]:
    """Mask of the words inside occurrences (None: no occurrence), added to the one given, and the items found."""
    found: set[int] = set()
    for t in made:
        for start, items in t.search(words):
            if mask is None:
                mask = np.zeros(len(words), bool)
            mask[start : start + t.m] = True
            found.update(items)
    return mask, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of docs.

    A narrow scan: every document is searched whole where it is read; nothing is shuffled. The test items go to the
    executors as a broadcast of about table_bytes of text; a larger benchmark is searched in parts, one after the other,
    and the hits add up in a written table. Null or empty text: no words, nothing hit. A null item text holds no
    window. Items without an id mark words but are not listed. Repeated items count once by id. Other columns are
    not read. An empty benchmark hits nothing; empty docs give no rows.
    """
    lean(docs)
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // table_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    at = docs.select("doc_id", "text")
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        last = part == parts - 1
        found = _pass(at, Search([(r[0], r[1]) for r in mine.collect()], window), part == 0, last, kind)
        found = found if last else saved(found, "hits")
        if 0 < part < parts - 1:
            dropped(at)
        at = found
    return at


def _pass(docs: DataFrame, items: Search, first: bool, last: bool, kind: str) -> DataFrame:
    """One set of tables over the documents; between passes the hits travel in columns `mask` and `names`."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    end = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids = shared.value.tables()
        for b in sliced(batches):
            masks, names, rows = [], [], []
            before = [None] * b.num_rows if first else b.column("mask").to_pylist()
            had = [None] * b.num_rows if first else b.column("names").to_pylist()
            for text, old, known in zip(texts(b.column("text")), before, had, strict=True):
                words = words_of(text)
                mask, found = hits(words, made, None if old is None else np.frombuffer(old, bool).copy())
                all_names = sorted(set(known or ()).union(*(ids[i] for i in found)))
                if last:
                    n_hit = 0 if mask is None else int(mask.sum())
                    rows.append((len(words), n_hit, len(all_names), hashlib.sha256(",".join(all_names).encode()).hexdigest() if all_names else NO_ITEMS, n_hit > 0))
                else:
                    masks.append(None if mask is None else mask.tobytes())
                    names.append(all_names)
            if last:
                cols = zip(*rows, strict=True) if rows else [()] * len(end)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *end])
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(masks, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "mask", "names"])

    out = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last else "text string, mask binary, names array<string>"
    return docs.mapInArrow(run, f"doc_id {kind}, {out}")
