"""Every query that has SQL against DuckDB, and the driver's contract."""

import math
import re
import unicodedata
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from pyspark.sql import functions as F

from tamiz.functions import lexicon
from tamiz.functions import text as T
from tamiz.operators import chunking, retrieval
from tamiz.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = lambda found, at: sorted(tuple(plain(r[at(c)]) for c in order) for r in found)
    assert rows(got.collect(), lambda c: c) == rows(want.fetchall(), names.index)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_query_expansion_reads_whole_items(spark, sf, tmp_path):
    marks = ["fiebre", "wound care", "dolor de rodilla", "shower", ""]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(10_000_004, "x " * 5000 + "escalofrios")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def brute(query):
        q = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
        extra = []
        for es, english in lexicon.TERMS.items():
            if es in q:
                extra += [e for e in english if e not in q]
            elif any(re.search(rf"\b{re.escape(e)}\b", q) for e in english):
                extra.append(es)
        return f"{query} {' '.join(dict.fromkeys(extra))}" if extra else query

    got = {r.item_id: r.expanded for r in QUERIES["query_expansion"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(" ".join(x for x in (marks[i % 5], t) if x is not None)) for i, t in items}
    assert got[10_000_004].endswith("escalofrios chills")


def test_small_to_big_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "source as file", "text")
    parents = chunking.parents(chunking.sections(docs)).collect()
    text = {r.parent_id: r.text for r in parents}
    chunks = chunking.children(chunking.parents(chunking.sections(docs)), F.lit(""))
    parent_of = {r.chunk_id: r.parent_id for r in chunks.select("chunk_id", "parent_id").collect()}
    assert set(parent_of.values()) <= set(text)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id as query_id", "text")
    by = {}
    for r in retrieval.bm25(chunks.select("chunk_id", "text"), items).orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append(r.chunk_id)
    want, dropped = set(), 0
    for q, hits in by.items():
        seen, prints, n = set(), set(), 0
        for c in hits:
            p = parent_of[c]
            mark = re.sub(r"\s+", "", text[p])[:300].lower()
            dropped += p in seen
            if p in seen or mark in prints or n == 6:
                seen.add(p)
                continue
            seen.add(p), prints.add(mark)
            n += 1
            want.add((q, n, p, c))
    got = {(r.query_id, r.n, r.parent_id, r.chunk_id) for r in QUERIES["small_to_big"](spark, sf).collect()}
    assert got == want and dropped


def test_sentence_stream_by_brute_force(spark, sf):
    whole = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    for r in QUERIES["sentence_stream"](spark, sf).collect():
        text = whole[r.conv_id, r.turn]
        assert " ".join(" ".join(r.sentences).split()) == " ".join(text.split())
        assert all(len(s) >= 25 and s[-1] in ".!?…" for s in r.sentences[:-1])


def test_bm25_reads_the_texts_once(spark, sf):
    plan = QUERIES["bm25_topk"](spark, sf)
    plan.collect()
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in shown or shown.count("documents.parquet") == 1, shown


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_context_window_finds_parts_of_words(spark, tmp_path):
    long = "alpha beta gamma " * 20
    items = [(1, "abc def"), (2, "single"), (3, long), (4, None), (5, ""), (6, "two words"), (7, "in the middle")]
    docs = [(100, "xabc defg and more"), (101, "a singleton here"), (102, f"before {long} after"), (103, None), (6, "nothing of it"), (104, "xin the middles")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.item_id, r.doc_id): r.excerpt for r in QUERIES["context_window"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = {r[:2]: r[2] for r in con.execute(ORACLE["context_window"]).fetchall()}
    assert got == want and {(1, 100), (2, 101), (3, 102), (6, 6), (7, 104)} <= set(got)


def test_bm25_does_not_shuffle_scores(spark, sf):
    shown = QUERIES["bm25_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id", shown), shown  # the best of each task alone


def test_words_in_tasks_are_those_of_columns(spark):
    # every character of the basic plane, between letters and alone; of surrogates there are none in texts
    texts = [" ".join(f"x{chr(c)}b {chr(c)}{chr(c)}" for c in range(a, a + 1024)) for a in range(0, 1 << 16, 1024) if not 0xD800 <= a < 0xE000] + [None, "", "El THE Ñandú niño nĩo áá"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    want = {r.chunk_id: r.w for r in rows.select("chunk_id", T.tokens(F.col("text")).alias("w")).collect()}
    terms = {w: n for n, w in enumerate(sorted({w for found in want.values() for w in found}))}
    words = retrieval.Words(terms, None)
    for i, text in enumerate(texts):
        length, numbers, counts = words.counts(text)
        assert length == len(want[i]) and dict(zip(numbers.tolist(), counts.tolist(), strict=True)) == Counter(terms[w] for w in want[i])
