"""Sections, parent blocks and overlapping child chunks of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tamiz.functions import text as T

#: Tokens of a parent at most, of a child, of its overlap.
PARENT, CHILD, OVERLAP = 1100, 250, 40
#: Shortest child in characters; letters of a word that count as one token where no model's tokenizer is at hand.
SHORTEST, LETTERS = 60, 40
#: A line is a heading if it is so much larger than the median, of so many characters, and its section has so many.
LARGER, HEADING, SECTION = 1.18, (3, 90), 400
WORD = re.compile(r"\S+")


def sections(docs: DataFrame) -> DataFrame:
    """Markdown (doc_id, file, text) cut before headings of levels 1 to 3: (doc_id, pos, section, text)."""
    parts = docs.select("doc_id", "file", F.posexplode(F.split("text", r"(?m)(?=^#{1,3} )")).alias("pos", "text")).where(F.trim("text") != "")
    heading = F.regexp_extract("text", r"^#{1,3} +([^\n]*)", 1)
    return parts.select("doc_id", "pos", F.left(F.when(heading != "", F.trim(heading)).otherwise(F.col("file")), F.lit(120)).alias("section"), "text")


def outline_sections(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections of an outline (doc_id, pos, title, page): each ends on the page where the next one starts, the last on
    the last page; boundary pages belong to both. pages: (doc_id, page, text); blank sections are dropped."""
    last = pages.groupBy("doc_id").agg(F.max("page").alias("last"))
    spans = marks.withColumn("next", F.lead("page").over(Window.partitionBy("doc_id").orderBy("pos"))).join(last, "doc_id").select("doc_id", "pos", F.left("title", F.lit(120)).alias("section"), F.col("page").alias("page_from"), F.coalesce("next", "last").alias("page_to"))
    found = spans.join(pages, "doc_id").where(F.col("page").between(F.col("page_from"), F.col("page_to")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")
    return found.groupBy("doc_id", "pos", "section", "page_from", "page_to").agg(text.alias("text")).where(F.trim("text") != "")


def font_sections(lines: DataFrame) -> DataFrame:
    """Sections of documents without an outline, by their lines (doc_id, page, pos, text, sizes of type).

    A line is a heading if its largest type is LARGER than the document's median one, it is short, doesn't end like a
    sentence, and the section before it has over SECTION characters; other such lines are text. (doc_id, pos, section,
    page_from, page_to, text); the first section is `Inicio`.
    """
    filled = lines.withColumn("text", F.trim("text")).where("text <> ''")
    sizes = F.sort_array(F.flatten(F.collect_list(F.when(F.trim("text") != "", F.col("sizes")))))
    bodies = lines.groupBy("doc_id").agg(sizes.alias("all"), F.max("page").alias("last")).select("doc_id", "last", F.coalesce(F.try_element_at("all", F.floor(F.size("all") / 2).cast("int") + 1), F.lit(10.0)).alias("body"))
    length = F.length("text")
    large = (F.array_max("sizes") > LARGER * F.col("body")) & (length > HEADING[0]) & (length < HEADING[1]) & ~F.col("text").rlike("[.,;]$")
    marked = filled.join(bodies, "doc_id").select("doc_id", "last", F.struct("page", "pos", "text", large.alias("large")).alias("line"))
    every = marked.groupBy("doc_id", "last").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"))

    def step(now: Column, line: Column) -> Column:
        new = line["large"] & (now["size"] > SECTION)
        size = F.when(new, 0).otherwise(now["size"] + F.length(line["text"]) + 1)
        # of a section only the place of its first line is kept
        return F.struct((now["at"] + 1).alias("at"), size.alias("size"), F.when(new, F.array_append(now["starts"], now["at"])).otherwise(now["starts"]).alias("starts"))

    return _joined_lines(every.withColumn("starts", F.aggregate("lines", start, step)["starts"]))


def _joined_lines(placed: DataFrame) -> DataFrame:
    one = placed.select("doc_id", "last", "starts", F.posexplode("lines").alias("at", "x"))
    section = F.size(F.filter("starts", lambda first: first <= F.col("at")))
    one = one.select("doc_id", "last", "at", section.alias("pos"), F.col("x.page").alias("page"), F.col("x.text").alias("line"))
    found = one.groupBy("doc_id", "last", "pos").agg(F.min("page").alias("page_from"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    heading = F.when(F.col("pos") == 0, "Inicio").otherwise(F.left(F.col("lines")[0]["line"], F.lit(120)))
    rest = F.when(F.col("pos") == 0, F.col("lines")).otherwise(F.slice("lines", 2, F.greatest(F.lit(1), F.size("lines"))))
    text = F.array_join(F.transform(rest, lambda x: F.concat(x["line"], F.lit("\n"))), "")
    page_to = F.coalesce(F.lead("page_from").over(Window.partitionBy("doc_id").orderBy("pos")), F.col("last"))
    pages = F.when(F.col("pos") == 0, 1).otherwise(F.col("page_from"))
    return found.select("doc_id", "pos", heading.alias("section"), pages.alias("page_from"), page_to.alias("page_to"), text.alias("text")).where(F.trim("text") != "")


def cleaned(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\.{4,}", " "), r"\n{3,}", "\n\n"))


#: Where a block may end, best first: paragraphs, lines, sentences, words.
ENDS = [re.compile(p) for p in (r"\n\n+", r"\n", r"(?<=[.!?])\s+", r"\s+")]


class Tokens:
    """Where the tokens of texts begin, from one encoding of each: white-space words, or a tokenizer's own tokens.

    A tokenizer is a path to its file, which every executor can read; the special tokens that it puts around a text count
    for each piece of it.
    """

    def __init__(self, tokenizer: str | None = None):
        self.model, self.special = None, 0
        if tokenizer:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(tokenizer)
            self.special = self.model.num_special_tokens_to_add(False)

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        if self.model:
            found = self.model.encode_batch(texts, add_special_tokens=False)
            return [np.array([a for a, _ in e.offsets], np.int64) for e in found]
        return [np.array([at for m in WORD.finditer(t) for at in range(m.start(), m.end(), LETTERS)], np.int64) for t in texts]

    def sizes(self, texts: list[str]) -> np.ndarray:
        if not self.model:
            return np.array([sum(-(-len(w) // LETTERS) for w in WORD.findall(t)) for t in texts], np.int64)
        return np.array([len(s) + self.special for s in self.starts(texts)], np.int64)


def spans(text: str, starts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(from, to) of blocks of at most `most` tokens, of which starts says where they begin.

    A span with more is cut at the best kind of end that it has; neighbouring pieces go together as far as their tokens,
    differences of places among starts, allow. What has no end is cut between tokens.
    """
    before = lambda at: np.searchsorted(starts, at)
    done, todo = [], [(0, len(text), 0)]
    while todo:
        a, b, kind = todo.pop()
        if before(b) - before(a) <= most:
            done.append((a, b))
        elif kind == len(ENDS):
            cuts = [a, *starts[before(a) + most : before(b) : most].tolist(), b]
            done += zip(cuts, cuts[1:], strict=False)
        else:
            cuts = np.array([a, *(m.end() for m in ENDS[kind].finditer(text, a, b) if m.end() < b), b])
            upto = before(cuts)
            k = 0
            while k < len(cuts) - 1:
                to = max(k + 1, int(np.searchsorted(upto, upto[k] + most, "right")) - 1)
                todo.append((int(cuts[k]), int(cuts[to]), kind + 1))
                k = to
    return sorted(done)


def blocks(texts: list[str], most: int = PARENT, tokens: Tokens | None = None) -> list[list[str]]:
    """The blocks of each text, without white space around them. A block that has more tokens by itself than within its text is cut
    again, so none has over `most`, special ones counted."""
    tokens = tokens or Tokens()
    out, room = [], max(1, most - tokens.special)
    for text, starts in zip(texts, tokens.starts(texts), strict=True):
        found = [b for b in (text[a:z].strip() for a, z in spans(text, starts, room)) if b]
        if tokens.model and len(found) > 1:
            sizes = tokens.sizes(found)
            found = [c for block, n in zip(found, sizes.tolist(), strict=True) for c in ([block] if n <= most or len(block) < 2 else blocks([block], most - (n - most), tokens)[0])]
        out.append(found or [""])
    return out


def children_of(sentences: list[str], sizes: np.ndarray, size: int = CHILD, overlap: int = OVERLAP) -> list[str]:
    """Sentences packed to about `size` tokens; each chunk begins with the last sentences, of `overlap` tokens, before it."""
    upto = np.r_[0, np.cumsum(sizes)]
    out, first, new = [], 0, 0
    while new < len(sentences):
        end = max(new + 1, int(np.searchsorted(upto, upto[first] + size, "right")) - 1)
        out.append(" ".join(sentences[first:end]))
        first, new = max(first, int(np.searchsorted(upto, upto[end] - overlap, "right")) - 1), end
    return [c for c in out if len(c) > SHORTEST]


#: Texts that a task cuts at once, and bytes of a batch that it is handed: what it holds doesn't grow with the input.
TEXTS, BATCH_BYTES = 64, "4000000"


def _lean(df: DataFrame) -> None:
    """Spark hands 10,000 rows at once to Python, of any length; here they are texts, so bytes count where the session doesn't say."""
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", str((1 << 63) - 1), str((1 << 31) - 1)):
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _slices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield batch.iloc[at : at + TEXTS]


def _blocks(tokenizer: str | None):
    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Tokens(tokenizer)
        for text in _slices(batches):
            yield pd.Series(blocks(text.tolist(), PARENT, tokens), dtype=object)

    return run


def _children(tokenizer: str | None):
    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Tokens(tokenizer)
        for found in _slices(batches):
            # each sentence of some texts is encoded once
            every = [list(s) for s in found]
            sizes = tokens.sizes([x for s in every for x in s]) - tokens.special
            ends = np.cumsum([len(s) for s in every]) if every else []
            yield pd.Series([children_of(s, sizes[e - len(s) : e]) for s, e in zip(every, ends, strict=True)], dtype=object)

    return run


def parents(found: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, parent_id, section, text) of sections (doc_id, pos, section, text); contents and references are left out."""
    _lean(found)
    good = found.where(~T.is_toc(F.col("section"), F.col("text"))).withColumn("text", cleaned(F.col("text"))).where("text <> ''")
    cut = good.withColumn("parts", _blocks(tokenizer)("text"))
    one = cut.select("doc_id", "pos", "section", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "text"))
    name = F.when(F.col("n") > 1, F.concat("section", F.lit(" ("), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.col("section"))
    return one.select("doc_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.col("part").cast("string")).alias("parent_id"), name.alias("section"), "text")


def statuses(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs with n_chunks and a status: ok, or error_sin_texto where no chunk came of a document."""
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return docs.join(counted, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).withColumn("status", F.when(F.col("n_chunks") > 0, "ok").otherwise("error_sin_texto"))


def with_children(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """The parents that have a chunk."""
    return found.join(chunks.select("parent_id").distinct(), "parent_id", "left_semi")


def children(found: DataFrame, title: Column | None = None, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, parent_id, chunk_id, section, text, embed_text) of parents; embed_text carries title and section."""
    _lean(found)
    cut = found.withColumn("parts", _children(tokenizer)(T.sentences(F.col("text"))))
    one = cut.select("doc_id", "parent_id", "section", F.posexplode("parts").alias("n", "text"))
    return one.withColumn("chunk_id", F.concat_ws("/", "parent_id", F.col("n").cast("string"))).withColumn("embed_text", F.concat_ws(" | ", title if title is not None else F.lit(""), "section", "text")).drop("n")
