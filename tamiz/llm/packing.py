"""Best-fit packing by the sum-of-squares rule (Csirik et al., 1999).

Documents are encoded whole, cut only where they are longer than a sequence, and dealt to groups of bounded size.
In a group the longest pieces come first; each goes where the sum of the squared counts of open sequences per
residual gap becomes smallest. What ends with gaps is then emptied into the gaps of the others, best fit first.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.store import lean, saved
from tamiz.llm.words import ENTRY, LONG, REMEMBERED, frees, sliced, texts

#: Tokens in a sequence; pieces in a group that one task packs.
TOKENS, GROUP = 2048, 50_000
#: Documents encoded together, and bytes of their texts.
TOGETHER, TEXT_BYTES = 500, 2_000_000


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == kind)


#: Characters below this one are split here, as the tokenizer's own splitter does it; those that it takes for white space.
PLAIN, SPACE = 0x250, r"\t-\r \x85\xa0"
UNITS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{SPACE}{_class('L')}{_class('N')}]+")
#: Characters that are left to the whole tokenizer: others, controls, and capitals whose small form lies beyond.
PLAINLY = "".join(re.escape(chr(c)) for c in range(PLAIN) if (c > 31 or 8 < c < 14) and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < PLAIN)
HAS_ODD, ODD_WORD = re.compile(f"[^{PLAINLY}]"), re.compile(rf"(?<![^{SPACE}])([^{SPACE}]*[^{PLAINLY}][^{SPACE}]*)")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, with id 0 at the end.

    The tokenizer's own tokens (like <|endoftext|>) are looked for in the whole text first, as it does. Between them it
    lowers letters, drops white space and never joins units (runs of letters, single digits, runs of other characters), so the
    ids of a text are those of its units in turn. Each different unit is encoded once and remembered; words with characters
    past U+024F go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 3 * REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.most, self.held = most, 0
        self.model, self.letters = self.tokenizer.model, byte_letters()
        own = self.tokenizer.get_added_tokens_decoder()
        self.own = {t.content: struct.pack("<I", i) for i, t in own.items()}
        self.splits = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.own, key=len, reverse=True)) + ")") if own else None
        self.known.update(self.own)

    def parts(self, raw: bytes | None) -> list[str]:
        """Units, odd words and own tokens of a text in their order."""
        text = (raw or b"").decode()
        if not any(t in text for t in self.own):
            return self.units(text)
        return [u for k, part in enumerate(self.splits.split(text)) for u in ([part] if k % 2 else self.units(part))]

    def units(self, text: str) -> list[str]:
        if text.isascii() and text.isprintable() or not HAS_ODD.search(text):
            return UNITS.findall(text.lower())
        return [u for k, part in enumerate(ODD_WORD.split(text)) for u in ([part] if k % 2 else UNITS.findall(part.lower()))]

    def __call__(self, batch: list[bytes | None]) -> list[bytes]:
        units = [self.parts(t) for t in batch]
        if self.held > self.most:
            self.known = dict(self.own)
            self.held = 0
        new = set().union(*units).difference(self.known)
        odd = [u for u in new if HAS_ODD.search(u)]
        self.known.update(zip(odd, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)), strict=True))
        self.known.update((u, self.unit(u)) for u in new.difference(odd))
        out = [b"".join(map(self.known.__getitem__, u)) + b"\0\0\0\0" for u in units]
        for u in new:
            size = len(u) + len(self.known[u]) + ENTRY
            if len(u) > LONG:
                del self.known[u]
            else:
                self.held += size
        return out

    def unit(self, unit: str) -> bytes:
        letters = unit if unit.isascii() and unit.isprintable() else unit.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, tokenizer: str, tokens: int = TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; null text counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        encode = Encoder(tokenizer)
        for b in sliced(batches, TOGETHER, TEXT_BYTES):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, ids in enumerate(encode(texts(b.column("text")))):
                for piece, start in enumerate(range(0, len(ids) // 4, tokens)):
                    cut = ids[4 * start : 4 * (start + tokens)]
                    for to, x in zip(rows, (i, piece, start, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        to.append(x)
            at, piece, start, length, crc = rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin number of each item; items are taken in the order given."""
    count = np.zeros(size + 1, np.int64)  # open bins by gap; a full bin (gap 0) isn't open
    stacks: dict[int, list[int]] = defaultdict(list)
    bins, out = 0, np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        # change of the sum of squares for gaps s..size, less the 2 that most share; the last is a new bin
        after = 2 * count[: size + 1 - s]
        after[0] = -1  # nothing stays open
        change = after - 2 * count[s:]
        change[count[s:] == 0] = 1 << 40
        change[-1] = after[-1] - (s < size)
        best = int(change[::1].argmin()) + s
        if best == size:
            number, bins = bins, bins + 1
        else:
            number = stacks[best].pop()
            count[best] -= 1
        out[i] = number
        if best > s:
            stacks[best - s].append(number)
            count[best - s] += 1
    return out


def emptied(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """The same packing with the bins that have most room emptied into the gaps of others, as long as that goes."""
    bins = bins.copy()
    room = size - np.bincount(bins, lengths, minlength=int(bins.max()) + 1).astype(np.int64)
    held = defaultdict(list)
    for i, b in enumerate(bins.tolist()):
        if room[b]:
            held[b].append(i)
    by_gap: dict[int, list[int]] = defaultdict(list)
    for b in held:
        by_gap[int(room[b])].append(b)
    has = np.zeros(size + 1, bool)
    has[list(by_gap)] = True
    for b in sorted(held, key=lambda b: -room[b]):
        if not room[b]:
            continue  # filled meanwhile
        by_gap[int(room[b])].remove(b)
        has[room[b]] = bool(by_gap[int(room[b])])
        moves = []
        for i in sorted(held[b], key=lambda i: -lengths[i]):
            fit = np.flatnonzero(has[lengths[i] :])
            if not len(fit):
                break
            gap = int(fit[0] + lengths[i])
            to = by_gap[gap].pop()
            has[gap] = bool(by_gap[gap])
            left = gap - int(lengths[i])
            if left:
                by_gap[left].append(to)
                has[left] = True
            moves.append((i, to, gap))
        if len(moves) == len(held[b]):
            for i, to, _ in moves:
                bins[i] = to
                held[to].append(i)
                room[to] -= lengths[i]
            room[b] = 0
            continue
        for i, to, gap in reversed(moves):
            left = gap - int(lengths[i])
            if left:
                by_gap[left].remove(to)
                has[left] = bool(by_gap[left])
            by_gap[gap].append(to)
            has[gap] = True
        break
    return bins


def pack(docs: DataFrame, tokenizer: str | None = None, tokens: int = TOKENS, group: int = GROUP) -> DataFrame:
    """Every document's pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Full pieces are sequences of their own. The others are counted and dealt to as few groups of about `group` pieces as
    hold them, by a hash of each row's place in the written table (equal rows part too), so a group never grows with the
    input; each wastes less than a sequence or two. Null text is packed as an empty document (id 0 alone), null and
    repeated doc_ids like any others; empty docs give no rows. Other columns are not read.
    """
    lean(docs)
    made = saved(pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), tokens), "pieces")
    rest = made.where(F.col("length") < tokens)
    groups = max(1, -(-rest.count() // group))
    names = [*made.columns, "sequence_id", "offset"]

    def place(table: pa.Table) -> pa.Table:
        number = table.column("part")[0].as_py()
        table = table.drop_columns("part").sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy()
        bins = emptied(lengths, sum_of_squares(lengths, tokens), tokens)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        return pa.table([*table.columns, pa.array(bins * groups * 2 + number * 2), pa.array(offset)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    whole = made.where(F.col("length") == tokens).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1)
    return whole.withColumn("offset", F.lit(0).cast("long")).unionByName(dealt.groupBy("part").applyInArrow(place, out))
