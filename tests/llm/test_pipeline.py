"""The pipeline's stages: columns, decisions and what each keeps."""

import re

import corpus_pipeline
from tamiz.llm import decontam, jaccard, substring, toxicity
from tamiz.session import table


def test_stages(spark, sf):
    docs, labels, benchmark = (table(spark, sf, n) for n in ("documents", "labels", "benchmark"))
    names = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        if number == 0:
            gone = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
        elif number == 1:
            gone = {r.doc_id for r in jaccard.link(docs).where("doc_id <> component_id").collect()}
        elif number == 2:
            cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup(docs).where("n_removed > 0").collect()}
            gone = {i for i, (n, k) in cut.items() if n == k}
        elif number == 3:
            gone = {r.doc_id for r in decontam.decontaminate(docs, benchmark).where("contaminated").collect()}
        else:
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert sorted(out.columns) == sorted(names)
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) == set(before) - gone
        if number == 2:
            for i, text in after.items():
                n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
                assert text == before[i] if i not in cut else n == cut[i][0] - cut[i][1]
        else:
            assert all(before[i] == t for i, t in after.items())
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_empty_and_null_rows(spark, sf):
    schema = table(spark, sf, "documents").schema
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 120, "en", "s", 600), (4, "word " * 120, "en", "s", 600)], schema)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = spark.createDataFrame(out.collect(), out.schema) if "text" in out.columns else out
    assert {r.doc_id for r in docs.collect()} == {None, 1, 2, 3}
