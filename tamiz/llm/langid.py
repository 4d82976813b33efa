"""Language of words and documents by a linear-chain conditional random field.

States are the learned languages, tokens the words of a text. A word's features are its affixes, character n-grams
and itself (the lexicon); transitions between the languages of neighbouring words are learned from labelled texts
and from texts spliced of two languages, as code-switched text is. Forward-backward gives each word's posterior;
a document's scores are the means of those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.labelled import remainder
from tamiz.llm.store import lean
from tamiz.llm.words import ENTRY, REMEMBERED, frees, mixed, sliced, stretches

#: Languages that are learned (those with most documents); labelled documents of each in the sample, words of each that
#: are learned from, in so many stretches of its text; hashed features, passes.
LANGS, SAMPLE, WORDS, STRETCHES, SPACE, PASSES = 100, 300, 120, 4, 1 << 16, 12
#: Numbers of the chains that are decoded together; no letter: no language.
CELLS, UNKNOWN = 400_000, "und"
_EDGES = " \t\n\r.,;:!?¡¿\"'()[]{}*#$%&|<>=+-_/\\0123456789"


def bare(word: str) -> str:
    """A word in lower case without marks and digits at its ends; empty if it has no letter."""
    w = word.strip(_EDGES).lower()
    return w if w.isalpha() or any(map(str.isalpha, w)) else ""


def lettered_words(words: list[str], most: int) -> list[str]:
    """Up to `most` of the words, bare, in stretches spread over them."""
    found = [x for x in map(bare, words) if x]
    each = most // STRETCHES
    if len(found) <= most:
        return found
    return [w for k in range(STRETCHES) for w in found[k * (len(found) - each) // (STRETCHES - 1) :][:each]]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of non-empty words, one word after the other, and how many each has.

    A word has itself, its affixes of up to 3 letters and its n-grams of 2 and 3, each with a salt of its kind.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(codes))  # letters from a position to its word's end
    shift = [np.uint64(0), np.uint64(21), np.uint64(42)]
    padded = np.r_[codes, np.zeros(3, np.uint64)]
    grams = [codes]  # of 1, 2, 3 letters from each position
    for k in (1, 2):
        grams.append(grams[-1] | (padded[k : k + len(codes)] << shift[k]))
    found, of = [stretches(mixed(codes), starts, ends)], [np.arange(len(words))]
    for k in (1, 2, 3):
        at = np.flatnonzero(left >= k)
        long_ = np.flatnonzero(sizes >= k)
        for salt, places, whose in ((10 * k, at, owner[at]), (10 * k + 1, starts[long_], long_), (10 * k + 2, ends[long_] - k, long_)):
            if salt != 10:  # single letters say little
                found.append(mixed(grams[k - 1][places] + (np.uint64(salt) << np.uint64(56))))
                of.append(whose)
    flat, of = np.concatenate(found) % np.uint64(SPACE), np.concatenate(of)
    return flat[np.argsort(of, kind="stable")].astype(np.int64), np.bincount(of, minlength=len(words))


def forward_backward(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of each word, and summed posteriors of neighbouring pairs, of sequences sorted by falling length.

    emission (sequence, word, state), start and transition hold exponentials; every sequence has a word at least.
    """
    n, longest, states = emission.shape
    alpha, beta = np.zeros_like(emission), np.ones_like(emission)
    scale = np.ones((n, longest))
    live = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences that reach a word
    a = emission[:, 0] * start
    for t in range(longest):
        k = live[t]
        if t:
            a = (alpha[:k, t - 1] @ transition) * emission[:k, t]
        s = a.sum(1)
        scale[:k, t] = s
        alpha[:k, t] = a / s[:, None]
    pairs = np.zeros((states, states))
    for t in range(longest - 1, 0, -1):
        k = live[t]
        right = emission[:k, t] * beta[:k, t] / scale[:k, t][:, None]
        pairs += transition * (alpha[:k, t - 1].T @ right)
        beta[:k, t - 1] = right @ transition.T
    post = alpha * beta
    return post / np.maximum(post.sum(2, keepdims=True), 1e-300), pairs


class Model:
    def __init__(self, langs: list[str]):
        self.langs = langs
        n = len(langs)
        self.weights, self.start, self.transition = np.zeros((SPACE, n), np.float32), np.zeros(n), np.eye(n) * 2.0

    def emissions(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-weights of words: the sum over features, divided by the square root of their number."""
        if not len(sizes):
            return np.zeros((0, len(self.langs)))
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0).astype(np.float64) / np.sqrt(sizes)[:, None]

    def train(self, texts_: list[tuple[list[str], list[int]]], passes: int = PASSES, rate: float = 0.5) -> None:
        """Maximises the likelihood of the words' labels, by AdaGrad over blocks of sequences, in a fixed order."""
        texts_ = sorted((x for x in texts_ if x[0]), key=lambda x: -len(x[0]))
        feats = [features(words) for words, _ in texts_]
        n = len(self.langs)
        g_w, g_t, g_s = np.full((SPACE, n), 1e-2, np.float32), np.full((n, n), 1e-2), np.full(n, 1e-2)
        order = np.random.default_rng(0)
        for _ in range(passes):
            for block in np.array_split(order.permutation(len(texts_)), max(1, len(texts_) // 64)):
                block = np.sort(block)
                lengths = np.array([len(feats[i][1]) for i in block])
                e = np.zeros((len(block), lengths.max(), n))
                gold = np.zeros_like(e)
                wanted = np.zeros((n, n))
                for r, i in enumerate(block):
                    e[r, : lengths[r]] = self.emissions(*feats[i])
                    y = np.array(texts_[i][1])
                    gold[r, np.arange(lengths[r]), y] = 1
                    np.add.at(wanted, (y[:-1], y[1:]), 1)
                e -= e.max(2, keepdims=True)
                post, pairs = forward_backward(np.exp(e), lengths, np.exp(self.start), np.exp(self.transition))
                wrong = gold - post
                flat = np.concatenate([feats[i][0] for i in block])
                each = np.concatenate([np.repeat(wrong[r, : lengths[r]] / np.sqrt(feats[i][1])[:, None], feats[i][1], axis=0) for r, i in enumerate(block)])
                used, place = np.unique(flat, return_inverse=True)
                grad = np.stack([np.bincount(place, each[:, k], len(used)) for k in range(n)], 1) - 1e-2 * self.weights[used]
                g_w[used] += grad * grad
                self.weights[used] += rate * grad / np.sqrt(g_w[used])
                step = wanted - pairs - 0.1 * self.transition
                g_t += step * step
                self.transition += 0.1 * step / np.sqrt(g_t)
                step = (gold - post)[:, 0].sum(0) - 0.1 * self.start
                g_s += step * step
                self.start += 0.1 * step / np.sqrt(g_s)


class Decoder:
    """Scores whole documents; remembers the emissions of words, up to `most` bytes of them."""

    def __init__(self, model: Model, most: int = 2 * REMEMBERED):
        self.model, self.known, self.most, self.held = model, {}, most, 0
        self.start, self.transition = np.exp(model.start), np.exp(model.transition)

    def __call__(self, texts_: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts_)
        if not self.model.langs:
            return out
        words = [t.split() if t else [] for t in texts_]
        self._learn(words)
        # words without a letter say nothing and are passed over
        rows = [[e for e in map(self.known.__getitem__, w) if e is not None] for w in words]
        order = sorted((i for i, r in enumerate(rows) if r), key=lambda i: -len(rows[i]))
        while order:
            some = max(1, CELLS // (len(rows[order[0]]) * len(self.model.langs)))
            block, order = order[:some], order[some:]
            lengths = np.array([len(rows[i]) for i in block])
            e = np.ones((len(block), lengths[0], len(self.model.langs)))
            for r, i in enumerate(block):
                e[r, : lengths[r]] = np.frombuffer(b"".join(rows[i]), np.float64).reshape(lengths[r], -1)
            post, _ = forward_backward(e, lengths, self.start, self.transition)
            for r, i in enumerate(block):
                mean = post[r, : lengths[r]].mean(0)
                best = int(mean.argmax())
                out[i] = (self.model.langs[best], float(min(1.0, mean[best])))
        return out

    def _learn(self, words: list[list[str]]) -> None:
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        stems: dict[str, list[str]] = {}
        for w in set().union(*words) - self.known.keys():
            stems.setdefault(bare(w), []).append(w)
            self.held += len(w) + ENTRY
        for w in stems.pop("", ()):
            self.known[w] = None
        e = self.model.emissions(*features(list(stems)))
        e = np.exp(e - e.max(1, keepdims=True)) if len(e) else e
        for same, x in zip(stems.values(), e, strict=True):
            self.known.update(dict.fromkeys(same, x.tobytes()))
        self.held += e.size * 8


def spread(words: Column, most: int, stretches_: int = STRETCHES) -> Column:
    """At most so many of an array's words, in stretches spread evenly over it from its start to its end."""
    each = most // stretches_
    cut = F.transform(F.sequence(F.lit(0), F.lit(stretches_ - 1)), lambda k: F.slice(words, (F.lit(1) + F.floor(k * (F.size(words) - each) / (stretches_ - 1))).cast("int"), F.lit(each)))
    return F.when(F.size(words) <= most, words).otherwise(F.flatten(cut))


def fit(docs: DataFrame, rows: int = SAMPLE, words: int = WORDS, langs: int = LANGS) -> Model:
    """Learns from at most `rows` documents of each of the `langs` most frequent languages, drawn by hash outside the
    held-out third; of each, `words` words with a letter from stretches spread over its whole text."""
    usable = docs.where("lang is not null and text is not null").where(remainder(F.col("doc_id"), 3) != 1)
    counted = usable.groupBy("lang").count()
    model = Model(sorted(r[0] for r in counted.orderBy(F.desc("count"), "lang").limit(langs).collect()))
    # ids are drawn first, each task passing on `rows` of a language; one scan then fetches the words
    draw = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id")
    ids = usable.select("doc_id", "lang").withColumn("at", F.dense_rank().over(draw)).where(F.col("at") <= rows).where(F.col("lang").isin(model.langs)).select("doc_id", "lang").distinct()
    lettered = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w.rlike(r"\p{L}"))
    found = usable.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "lang", spread(lettered, 2 * words).alias("w")).collect() if model.langs else []
    found.sort(key=lambda r: r["doc_id"])
    taken = [[r for r in found if r["lang"] == x] for x in model.langs]
    texts_: list[tuple[list[str], list[int]]] = []
    for k, found in enumerate(taken):
        for i, r in enumerate(found):
            own = lettered_words(r["w"], words)
            texts_.append((own, [k] * len(own)))
            if len(taken) > 1 and i % 4 == 0:  # code-switched: half of this text, then half of one in another language
                other = (k + 1 + (i // 4) % (len(taken) - 1)) % len(taken)
                if taken[other]:
                    more = lettered_words(taken[other][i % len(taken[other])]["w"], words // 2)
                    half = own[: words // 2]
                    texts_.append((half + more, [k] * len(half) + [other] * len(more)))
    if texts_ and any(x[0] for x in texts_):
        model.train(texts_)
    return model


def identify(docs: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of docs.

    score is the mean posterior of the predicted language over the words with a letter, all of the text's. A text
    that is null or has no letter gets `und` and 0. Without a labelled document all texts get `und`; with one
    language alone all texts with letters get that. Other columns are not read; empty docs give no rows.
    """
    model = lean(docs).sparkContext.broadcast(fit(docs if fit_on is None else fit_on))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model.value)
        for b in sliced(batches, 1000):
            found = decode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
