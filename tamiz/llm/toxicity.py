"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index.

All words of the examples are terms. A term's IDF is multiplied by its association with the label, so that the few
telling words outweigh the many that say nothing; no term is left out for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tamiz.llm.decontam import words_of
from tamiz.llm.labelled import base_rate, held_out, label_rate, logistic, probability, sample
from tamiz.llm.store import lean, lent
from tamiz.llm.words import frees, give_back, sliced, texts

#: Labelled rows of each label in the sample; neighbours; examples in a block; parts of the sample for the calibration.
SAMPLE, NEIGHBOURS, BLOCK, PARTS, THRESHOLD = 2000, 15, 64, 5, 0.5
#: Neighbours named as evidence; blocks of the largest bounds that are read first; one in so many examples makes a term common.
EVIDENCE, FIRST, COMMON = 3, 2, 16
#: Texts scored together.
TOGETHER = 256


def association(bags: list[np.ndarray], y: np.ndarray, terms: int) -> np.ndarray:
    """How far the presence of each term goes with the label: chi-square over the number of examples, 0 to 1 at any size."""
    n, n1 = float(len(y)), float(y.sum())
    df, one = np.zeros(terms), np.zeros(terms)
    for bag, label in zip(bags, y.tolist(), strict=True):
        df[bag] += 1
        if label:
            one[bag] += 1
    d = n1 * (n - n1) * df * (n - df)
    return np.divide((one * (n - n1 - df + one) - (n1 - one) * (df - one)) ** 2, d, out=np.zeros(terms), where=d > 0)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each range low..high, and the range that each belongs to."""
    n = high - low
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n), np.repeat(np.arange(len(n)), n)


Vector = tuple[np.ndarray, np.ndarray]


class Index:
    """Inverted lists of unit example vectors (terms, weights), cut into blocks of neighbouring examples.

    Examples are put in the order of their heaviest terms, so that a block holds like ones. A term that few examples hold
    has a list with its largest weight in each block; one that more than one in COMMON holds is a dense row.
    """

    def __init__(self, vectors: list[Vector], terms: int):
        self.size, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        heaviest = [(int(t[w.argmax()]), float(w.max())) if len(t) else (-1, 0.0) for t, w in vectors]
        #: the example that stands at each place
        self.order = np.array(sorted(range(self.size), key=heaviest.__getitem__), np.int64)
        term = np.concatenate([np.empty(0, np.int32), *(vectors[i][0] for i in self.order)])
        weight = np.concatenate([np.empty(0), *(vectors[i][1] for i in self.order)])
        place = np.repeat(np.arange(self.size, dtype=np.int32), [len(vectors[i][0]) for i in self.order])
        common = np.flatnonzero(np.bincount(term, minlength=terms) * COMMON > self.size)
        self.row = np.full(terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.size))
        often = self.row[term] >= 0
        self.dense[self.row[term[often]], place[often]] = weight[often]
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(term[rare], kind="stable")]
        term, self.ids, self.weights = term[rare], place[rare], weight[rare]
        block = self.ids // BLOCK
        # a run is what a list holds in one block
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])][: len(term)])
        self.block, self.start = block[first], np.r_[first, len(term)]
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.empty(0)
        self.lists = np.searchsorted(term[first], np.arange(terms + 1))

    def common(self, queries: list[Vector]) -> np.ndarray:
        """What the common terms give each example, for each query: one matrix product."""
        q = np.zeros((len(queries), len(self.dense)))
        for i, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            q[i, row[row >= 0]] = weights[row >= 0]
        return q @ self.dense

    def nearest(self, query: Vector, k: int, base: np.ndarray | None = None) -> Vector:
        """(examples, cosines) of the k nearest with a cosine over 0, and of all that are as near as the last of them."""
        found, scores = np.empty(0, np.int64), np.empty(0)
        if not len(query[0]) or not self.size:
            return found, scores
        base = self.common([query])[0] if base is None else base
        rare = self.row[query[0]] < 0
        terms, q = query[0][rare], query[1][rare]
        runs, of = _ranges(self.lists[terms], self.lists[terms + 1])
        # no example of a block can have more than its best of the common terms and the largest weights of the others
        bound = np.maximum.reduceat(base, np.arange(0, self.size, BLOCK)) + np.bincount(self.block[runs], self.most[runs] * q[of], self.blocks)
        order = np.argsort(-bound, kind="stable")
        for blocks in (order[:FIRST], order[FIRST:]):
            # blocks that can only fall short of the k-th are not read (the margin is for rounding)
            blocks = blocks[bound[blocks] > (0 if len(scores) < k else scores.min() - 1e-9)]
            if not len(blocks):
                break
            read = np.zeros(self.blocks, bool)
            read[blocks] = True
            mine = read[self.block[runs]]
            at, run = _ranges(self.start[runs[mine]], self.start[runs[mine] + 1])
            sums = np.round(base + np.bincount(self.ids[at], self.weights[at] * q[of[mine]][run], self.size), 12)
            places = np.flatnonzero((sums > 0) & np.repeat(read, BLOCK)[: self.size])
            found, scores = np.r_[found, places], np.r_[scores, sums[places]]
            if len(scores) > k:
                best = scores >= np.partition(scores, -k)[-k]
                found, scores = found[best], scores[best]
        found = self.order[found]
        best = np.lexsort((found, -scores))
        return found[best], scores[best]


def weighed(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> Vector:
    """Unit vector of terms that occur so often."""
    raw = (1 + np.log(counts)) * weights[terms]
    terms, raw = terms[raw > 0], raw[raw > 0]
    return terms.astype(np.int32), raw / math.sqrt((raw * raw).sum() or 1.0)


class Model:
    def __init__(self, terms: dict[bytes, int], weights: np.ndarray):
        self.terms, self.weights = terms, weights
        self.index = Index([], len(terms))
        self.ids: list[int] = []
        self.y = np.empty(0)
        self.w: np.ndarray | None = None
        self.rate = 0.25

    def vector(self, words: list[bytes]) -> Vector:
        known = [t for t in map(self.terms.get, words) if t is not None]
        return weighed(*np.unique(np.array(known, np.int32), return_counts=True), self.weights)

    def votes(self, queries: list[Vector]) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
        """(vote of label 1 weighted by nearness, how near the nearest is, neighbours, cosines) of each query."""
        base = self.index.common(queries)
        return [_vote(self.y, *self.index.nearest(q, NEIGHBOURS, b)) for q, b in zip(queries, base, strict=True)]

    def score(self, vote: float, near: float) -> float:
        return self.rate if self.w is None else float(probability(self.w, np.array([vote, near])))


def _vote(y: np.ndarray, found: np.ndarray, cosines: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    if not len(found):
        return 0.0, 0.0, found, cosines
    weight = 1 / (1.05 - cosines)
    return float(weight @ y[found] / weight.sum()), float(cosines[0]), found, cosines


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = SAMPLE) -> Model:
    """Learns from a bounded sample of labelled rows, all their words; document frequencies are counted over all documents."""
    drawn = sample(docs, labels, target, rows)
    y = np.array([label for _, _, label in drawn], int)
    both = len(set(y.tolist())) == 2
    place: dict[bytes, int] = {}
    bags = [np.unique(np.array([place.setdefault(w, len(place)) for w in words_of(t.encode())], np.int32), return_counts=True) for _, t, _ in drawn] if both else []
    ids = [i for i, _, _ in drawn]
    drawn.clear()  # the driver needs the texts no more
    n, df = _frequencies(docs, place)
    idf = np.log((1 + n) / (1 + df)) + 1
    model = Model(place, np.zeros(len(place)))
    model.rate = base_rate(y.tolist())
    if both:

        def learned(of: np.ndarray) -> tuple[np.ndarray, Index]:
            weights = idf * association([bags[i][0] for i in of], y[of], len(place))
            return weights, Index([weighed(*bags[i], weights) for i in of], len(place))

        every = np.arange(len(y))
        # the calibration asks each part of what the others teach, weights of terms included, and weighs labels as they occur
        x = np.zeros((len(y), 2))
        for part in range(PARTS):
            others = every[every % PARTS != part]
            weights, index = learned(others)
            for i in every[every % PARTS == part]:
                x[i] = _vote(y[others], *index.nearest(weighed(*bags[i], weights), NEIGHBOURS))[:2]
            del index
        model.weights, model.index = learned(every)
        model.ids, model.y = ids, y.astype(float)
        shares = np.bincount(y, minlength=2) / len(y)
        true = label_rate(labels, target)
        model.w = logistic(x, y.astype(float))
        model.w[0] += math.log(true / (1 - true)) - math.log(shares[1] / shares[0])
    return model


def _frequencies(docs: DataFrame, terms: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term."""
    places = docs.sparkSession.sparkContext.broadcast(terms)

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, counts = places.value, 0, np.zeros(len(places.value), np.int64)
        for b in batches:
            for text in texts(b.column("text")):
                n += 1
                counts[[place[w] for w in set(words_of(text)) if w in place]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, counts[at]])], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    places.destroy()
    term, count = found.column("term").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(len(terms))
    df[term[term >= 0]] = count[term >= 0]
    return int(count[term < 0].sum()), df


def score(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = THRESHOLD, fit_on: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row for each row of docs; evidence: (doc_id, cosine, label).

    A text without a word of an example, or null or empty, has no neighbours and gets the rate that such texts have among
    the labelled ones. Examples that are as near as the last neighbour vote too. Without labels of both kinds every score
    is the (shrunk) rate. Labels of repeated ids count once, a 1 before a 0. Other columns are not read; empty docs give
    no rows.
    """
    model = lean(docs).sparkContext.broadcast(fit(docs if fit_on is None else fit_on, labels, target))
    give_back()
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = labels.schema["doc_id"].dataType
    evidence = pa.list_(pa.struct([("doc_id", to_arrow_type(named)), ("cosine", pa.float64()), ("label", pa.int32())]))

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in sliced(batches, TOGETHER):
            scores, why = [], []
            for vote, near, found, cosines in m.votes([m.vector(words_of(text)) for text in texts(b.column("text"))]):
                scores.append(m.score(vote, near))
                why.append([{"doc_id": m.ids[e], "cosine": c, "label": int(m.y[e])} for e, c in zip(found[:EVIDENCE].tolist(), cosines[:EVIDENCE].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(why, evidence)], ["doc_id", "score", "predicted", "evidence"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id:{named.simpleString()},cosine:double,label:int>>")
    return lent(scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence"), model)
