"""Quality by compression: texts are compressed with a dictionary of good and one of bad labelled texts.

A text of blocks is compressed block by block under either dictionary; the difference of the two sizes, divided by
their sum, is the normalised difference. A logistic calibration turns those of the whole text and of its worst
block into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.labelled import base_rate, held_out, label_rate, logistic, probability, sample
from tamiz.llm.store import lean
from tamiz.llm.words import frees, sliced, texts

#: Labelled rows of each label in the sample; bytes of a dictionary, of a block; zstd level; score for a predicted 1.
SAMPLE, DICTIONARY, BLOCK, LEVEL, THRESHOLD = 2000, 112_000, 256, 3, 0.3
#: Bytes of blocks that a dictionary is trained on, as a multiple of its size.
TIMES = 100


class Sizes:
    """Compressed sizes of blocks under the dictionaries of bad (0) and good (1) texts."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.compress = []
        for raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw)  # trained, or plain bytes
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def features(self, text: bytes | None) -> tuple[float, float]:
        """(normalised difference of the whole text, that of its worst block); positive: nearer to good texts."""
        if not text:
            return 0.0, 0.0
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        bad, good = (np.array([len(c(x)) for x in blocks], float) for c in self.compress)
        each = (bad - good) / (bad + good)
        full = each[:-1] if len(text) % BLOCK and len(blocks) > 1 else each  # a short last block says little by itself
        return float((bad.sum() - good.sum()) / (bad.sum() + good.sum())), float(full.min())


def dictionary(samples: list[bytes], size: int = DICTIONARY, times: int = TIMES) -> bytes:
    """A zstd dictionary trained on blocks of the texts, evenly drawn from all of them so that they come to at most
    `times` its size; of few texts, their last bytes."""
    blocks = [t[i : i + BLOCK] for t in samples for i in range(0, len(t), BLOCK)]
    blocks = blocks[:: max(1, -(-len(blocks) * BLOCK // (times * size)))]
    try:
        return zstandard.train_dictionary(size, blocks, level=LEVEL, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:] or b"\0" * 8


class Model:
    def __init__(self, dictionaries: tuple[bytes, bytes] | None, w: np.ndarray | None, rate: float):
        self.dictionaries, self.w, self.rate = dictionaries, w, rate

    def scorer(self):
        if self.w is None:
            return lambda _: self.rate
        sizes = Sizes(self.dictionaries)
        return lambda text: float(probability(self.w, np.array(sizes.features(text))))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE) -> Model:
    """Dictionaries from one half of a bounded sample of labelled rows (whole texts), the calibration from the other half."""
    drawn = sample(docs, labels, target, rows, seed=1)
    y = [label for _, _, label in drawn]
    if len(set(y)) < 2 or min(sum(y), len(y) - sum(y)) < 4:
        return Model(None, None, base_rate(y))
    bad, good, bad2, good2 = ([t.encode() for _, t, label in drawn if label == kind][half::2] for half in (0, 1) for kind in (0, 1))
    dictionaries = (dictionary(bad), dictionary(good))
    sizes = Sizes(dictionaries)
    x = np.array([sizes.features(t) for t in bad2 + good2])
    w = logistic(x, np.r_[np.zeros(len(bad2)), np.ones(len(good2))])
    true = label_rate(labels, target)
    w[0] += np.log(true / (1 - true)) - np.log(len(good2) / len(bad2))
    return Model(dictionaries, w, base_rate(y))


def score(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs.

    Null and empty texts compress alike under both dictionaries (difference 0) and get that score. With fewer than
    four labels of either kind every score is the (shrunk) rate. Other columns are not read; no docs, no rows.
    """
    model = lean(docs).sparkContext.broadcast(fit(docs, labels, target))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.value.scorer()
        for b in sliced(batches):
            scores = [of(t) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
