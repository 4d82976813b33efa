"""Token counts by offset-mapped attribution.

A document is encoded once, whole. A byte-level tokenizer keeps every byte, so the running sum of its tokens' byte
lengths gives each token's span. Spans are joined by interval with the sections (lines) of the text; a token that
crosses a border counts for the section that holds most of its bytes, the earlier one of equals. So the sections'
counts add up to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tamiz.llm.store import lean
from tamiz.llm.words import frees, sliced, texts


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("tamiz", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), np.array([len(t) for t, _ in sorted(ranks.items(), key=lambda x: x[1])], np.int64)


def sections(text: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text end; a line holds its line feed."""
    feeds = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return feeds if len(feeds) and feeds[-1] == len(text) else np.r_[feeds, len(text)]


def attributed(ends: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, for token ends and section ends in bytes."""
    starts = np.r_[0, ends[:-1]]
    first, last = np.searchsorted(borders, starts, side="right"), np.searchsorted(borders, ends, side="left")
    owner, crossing = first.copy(), first < last
    for i in np.flatnonzero(crossing).tolist():
        low = np.maximum(np.r_[0, borders][first[i] : last[i] + 1], starts[i])
        owner[i] = first[i] + int((np.minimum(borders[first[i] : last[i] + 1], ends[i]) - low).argmax())
    n = len(borders)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, section, start, length, n_tokens, n_crossing), one row for each line of each document.

    start and length are in UTF-8 bytes. A null or empty text is one empty section without tokens. Null and repeated
    doc_ids are kept as they are; other columns are not read; empty docs give no rows. A narrow scan: nothing is
    shuffled or held but one batch of texts.
    """
    lean(docs)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema["doc_id"].dataType.simpleString()

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoding(path)
        for b in sliced(batches):
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for i, text in enumerate(texts(b.column("text"))):
                text = text or b""
                borders = sections(text)
                tokens, crossing = attributed(np.cumsum(sizes[encode.encode_ordinary(text.decode())]), borders) if text else (np.zeros(1, np.int64), np.zeros(1, np.int64))
                n = len(borders)
                starts = np.r_[0, borders[:-1]]
                for to, x in zip(cols, (np.full(n, i), np.arange(n), starts, borders - starts, tokens, crossing), strict=True):
                    to.append(x)
            flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(flat[0], pa.int64())), pa.array(flat[1], pa.int32()), *(pa.array(c, pa.int64()) for c in flat[2:])], ["doc_id", "section", "start", "length", "n_tokens", "n_crossing"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, section int, start long, length long, n_tokens long, n_crossing long")
