"""Words and rolling hashes of whole texts, in numpy, for code that runs inside Spark's Arrow tasks."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that split words, for `[^\x20\x09-\x0D]+`: just those at which bytes.split() splits.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ODD = 0x9E3779B97F4A7C15
ODD_INVERSE = pow(ODD, -1, 1 << 64)


#: Bytes that a task's memory of words may hold, by what Python takes for them; a word of more bytes is never kept.
REMEMBERED, LONG = 40_000_000, 512
#: What an entry of such a memory takes besides its word and value: places in the dict, object heads.
ENTRY = 200


class Hashes(dict):
    """64-bit hash of a word; remembers words of up to `most` bytes in all, then forgets them."""

    def __init__(self, most: int = REMEMBERED):
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[word] = got
            self.held += len(word) + ENTRY
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ODD and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((ODD, ODD_INVERSE)):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
    return _powers[0][:n], _powers[1][:n]


def stretches(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the words start..stop of each pair; equal words give equal hashes wherever they stand."""
    n = len(hashes)
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * up[:n], out=total[1:])
    return mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; empty if there are fewer."""
    at = np.arange(max(0, len(hashes) - k + 1))
    return stretches(hashes, at, at + k)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of so few rows and bytes of text that what is made of them stays small; a longer text is one by itself."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < b.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = min(first + rows, max(first + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(first, last - first)
            first = last


def give_back() -> None:
    """Memory that nothing holds any more goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def frees(run):
    """run, a generator over a task's batches; what it held is given back at its end, as Spark keeps its Python workers."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column of an Arrow batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
