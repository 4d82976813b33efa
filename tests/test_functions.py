"""Text, speech and rule functions on hand-written Spanish."""

import random
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamiz.functions import lexicon, speech
from tamiz.functions import text as T
from tamiz.operators import chunking, retrieval, rules


def one(spark, c, **cols):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(c.alias("x")).first()["x"]


def test_fold_and_tokens(spark):
    assert one(spark, T.fold(F.col("t")), t="ÁÉÍ óú Ñü ç") == "aei ou nu c"
    assert one(spark, T.fold(F.col("t")), t=unicodedata.normalize("NFD", "Hinchazón")) == "hinchazon"
    assert one(spark, T.tokens(F.col("t")), t="El dolor y la FIEBRE, 38 a x") == ["dolor", "fiebre", "38"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []


def test_language_scenario_title(spark):
    assert one(spark, T.language(F.col("t")), t="the care of the wound") == "en"
    assert one(spark, T.language(F.col("t")), t="") == "es"
    assert one(spark, T.scenario(F.lit("Cuidados"), F.col("t")), t="colon colon cadera") == "colectomia"
    assert one(spark, T.scenario(F.lit(""), F.col("t")), t="nada") == "general"
    assert one(spark, T.title_of(F.col("t")), t="/a/b/plan_de-cuidado.pdf") == "plan de cuidado"
    assert one(spark, T.for_patients(F.col("t")), t="Guía para el alta") is True


def test_window(spark):
    long = "a" * 50 + "needle" + "b" * 100
    assert one(spark, T.window(F.col("t"), F.lit("needle"), 40), t=long) == "…" + long[40:80] + "…"
    assert one(spark, T.window(F.col("t"), F.lit("zzz"), 40), t=long) == long[:40]
    assert one(spark, T.window(F.col("t"), F.lit("aaa"), 40), t=long) == long[:40] + "…"
    assert one(spark, T.window(F.col("t"), F.lit(""), 400), t=long) == long


@pytest.mark.parametrize(("text", "want"), [("treinta y nueve", "39"), ("38 punto cinco", "38.5"), ("veinte", "20"), ("dieciseis o una", "16 o 1")])
def test_digits(spark, text, want):
    assert one(spark, speech.digits(F.col("t")), t=text) == want


CASES = [
    ("tengo treinta y nueve de fiebre", {"fever": 39.0}),
    ("marcó 38,5 el termómetro", {"fever": 38.5}),
    ("fiebre desde hace treinta y seis horas", {"fever_felt": True}),
    ("tengo fiebre y no sé cuánto", {"fever_felt": True}),
    ("no tengo fiebre", {}),
    ("mi hijo tiene 39 de fiebre", {}),
    ("mi hija dice que tengo 39 de fiebre", {"fever": 39.0}),
    ("me duele siete de diez", {"pain": 7.0}),
    ("dos pastillas cada ocho horas para el dolor", {}),
    ("llevo 8 horas de dolor", {}),
    ("me duele hace 3 dias", {}),
    ("el dolor es 4 de 10 y llevo 9 horas de dolor", {"pain": 4.0}),
    ("treinta y 9 de fiebre", {"fever_felt": True}),
    ("el dolor está en seis y va subiendo", {"pain": 6.0, "pain_worse": True}),
    ("me falta el aire", {"dyspnoea": True}),
    ("sin sangrado", {}),
    ("me sangra la herida", {"bleeding": True}),
    ("", {}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_extraction(spark, text, want):
    got = one(spark, speech.extracted(F.col("t")), t=text).asDict()
    assert {k: v for k, v in got.items() if v is not None} == want


@pytest.mark.parametrize(("text", "want"), [("nada de pus", None), ("no me sale pus, bueno ahora sí me salió pus amarillo", "pus"), ("mi hijo bota pus", None), ("huele feo la herida", "huele feo"), ("se me abrió la herida", "se abrio la herida"), ("Pus", "pus"), (None, None)])
def test_quick_red(spark, text, want):
    got = one(spark, rules.quick_red(F.col("t")), t=text)
    assert got == want or (want == "se abrio la herida" and got in rules.QUICK_RED)


STATE = {"pain": "double", "fever": "double", "fever_felt": "boolean", "pain_worse": "boolean", "bleeding": "boolean", "dyspnoea": "boolean", "vomiting": "boolean", "wound": "string", "appetite": "string", "sleep": "string", "unquantified": "boolean", "minimising": "int", "others": "array<string>"}


def level(spark, procedure="", day=1, **s):
    row = {"unquantified": False, "minimising": 0, "others": []} | s
    df = spark.createDataFrame([tuple(row.get(k) for k in STATE)], ", ".join(f"{k} {v}" for k, v in STATE.items()))
    return df.select(rules.evaluate(df, F.lit(procedure), F.lit(day)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("state", "want"),
    [
        ({}, "verde"), ({"fever": 38.0}, "amarillo"), ({"fever": 38.49}, "amarillo"), ({"fever": 38.5}, "rojo"), ({"fever": 37.9}, "verde"), ({"fever_felt": True}, "verde"),
        ({"pain": 4.0}, "verde"), ({"pain": 5.0}, "amarillo"), ({"pain": 7.0}, "amarillo"), ({"pain": 8.0}, "rojo"), ({"pain_worse": True}, "amarillo"), ({"pain": 2.0, "pain_worse": True}, "verde"),
        ({"wound": "enrojecida_leve"}, "verde"), ({"wound": "hinchada"}, "amarillo"), ({"wound": "abierta"}, "rojo"), ({"bleeding": True}, "rojo"), ({"others": ["me desmayé"]}, "rojo"), ({"others": ["pantorrilla"]}, "amarillo"),
        ({"appetite": "nulo"}, "verde"), ({"appetite": "nulo", "sleep": "alterado"}, "amarillo"), ({"appetite": "nulo", "sleep": "alterado", "wound": "enrojecida_leve"}, "rojo"),
        ({"unquantified": True, "minimising": 1, "sleep": "alterado"}, "amarillo"), ({"unquantified": True, "sleep": "alterado"}, "verde"),
    ],
)
def test_levels(spark, state, want):
    assert level(spark, **state)["level"] == want


def test_reasons(spark):
    got = level(spark, "Reemplazo de rodilla", others=["pantorrilla"])
    assert got["level"] == "rojo" and "trombosis" in got["reasons"][0]
    assert level(spark, day=3, pain=2.0, pain_worse=True)["level"] == "amarillo"
    assert level(spark, fever=39.0)["reasons"] == ["Fiebre de 39 °C (umbral de alarma ≥38.5)"]
    assert level(spark, fever_felt=True)["missing"] == ["temperatura medida con termómetro"]
    assert level(spark)["reasons"] == ["Sin signos de alarma en lo reportado"]


def test_running_state_never_improves(spark):
    schema = "call_id int, turn int, pain double, fever double, fever_felt boolean, wound string, pain_worse boolean, bleeding boolean, dyspnoea boolean, vomiting boolean, appetite string, sleep string, mentioned boolean, minimises boolean, others array<string>"
    rows = [
        (1, 1, 6.0, 50.0, None, "secrecion_purulenta", None, True, None, None, "nulo", "alterado", False, True, ["a"]),
        (1, 2, 2.0, 38.2, False, "normal", None, False, None, None, "reducido", "normal", True, False, ["b", "a", ""]),
        (1, 3, None, None, None, None, None, None, None, None, None, None, False, None, None),
    ]
    got = [r.asDict() for r in rules.running_state(spark.createDataFrame(rows, schema)).orderBy("turn").collect()]
    assert got[0]["fever"] is None and got[0]["fever_felt"] is True
    assert got[2] == {"call_id": 1, "turn": 3, "pain": 6.0, "fever": 38.2, "fever_felt": True, "wound": "secrecion_purulenta", "pain_worse": None, "bleeding": True, "dyspnoea": None, "vomiting": None, "appetite": "nulo", "sleep": "normal", "unquantified": False, "minimising": 1, "others": ["a", "b"]}


def test_expansion(spark):
    e = lexicon.expanded(F.col("t"))
    assert one(spark, e, t="tengo fiebre") == "tengo fiebre fever temperature"
    assert one(spark, e, t="my knee") == "my knee rodilla"
    assert one(spark, e, t="nada") == "nada"
    assert one(spark, e, t="fiebre fever") == "fiebre fever temperature temperatura"


def test_blocks_of_one_endless_word():
    text = "x" * 50_000
    (out,) = chunking.blocks([text])
    assert "".join(out) == text and len(out) > 1 and max(chunking.Tokens().sizes(out)) <= chunking.PARENT


def test_blocks_and_children_by_a_tokenizer(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = chunking.Tokens(path)
    tokens.special = 2
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé123.,;ñ") for _ in range(r.randint(1, 14)))
    texts = ["".join(word() + r.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for _ in range(r.choice([5, 200, 3000]))) for _ in range(12)] + ["", "x" * 9000, "é" * 3000]
    for text, found in zip(texts, chunking.blocks(texts, 120, tokens), strict=True):
        assert all(len(tokens.model.encode(b, add_special_tokens=False).ids) + 2 <= 120 for b in found)
        assert "".join("".join(found).split()) == "".join(text.split())
    # neighbours were not needlessly parted: two paragraphs that fit stay together
    assert chunking.blocks(["one two\n\nthree four\n\nfive six seven"], 4) == [["one two\n\nthree four", "five six seven"]]
    docs = spark.createDataFrame([("d", "f.md", "# One\n" + "A sentence that says a little more than nothing at all. " * 400)], "doc_id string, file string, text string")
    parents = chunking.parents(chunking.sections(docs), path)
    plain = chunking.Tokens(path)
    assert parents.count() > 1 and max(plain.sizes([r.text for r in parents.collect()])) <= chunking.PARENT
    assert max(plain.sizes([r.text for r in chunking.children(parents, None, path).collect()])) <= chunking.CHILD


def test_chunks_and_statuses(spark):
    docs = spark.createDataFrame([("d", "f", "# One\n" + "A sentence that is long enough to be kept as a chunk. " * 3), ("e", "g", "short"), ("n", "h", None)], "doc_id string, file string, text string")
    parents = chunking.parents(chunking.sections(docs))
    chunks = chunking.children(parents)
    assert {r.doc_id: r.status for r in chunking.statuses(docs, chunks).collect()} == {"d": "ok", "e": "error_sin_texto", "n": "error_sin_texto"}
    assert {r.doc_id for r in chunking.with_children(parents, chunks).collect()} == {"d"}


def test_font_sections(spark):
    import random

    r = random.Random(4)
    rows = []
    for d in range(6):
        for i in range(r.randint(1, 120)):
            text = r.choice(["A heading", "ab", "Ends here.", "", "  ", "word " * r.randint(1, 30)])
            rows.append((d, i // 10 + 1, i, text, [r.choice([10.0, 10.0, 10.0, 11.0, 14.0]) for _ in range(r.randint(1, 3))]))
    want = []
    for d in range(6):
        mine = [x for x in rows if x[0] == d]
        sizes = sorted(s for x in mine if x[3].strip() for s in x[4])
        body = sizes[len(sizes) // 2] if sizes else 10
        found, name, page, text = [], "Inicio", 1, ""
        for _, p, _, line, size in mine:
            line = line.strip()
            if line and max(size) > 1.18 * body and 3 < len(line) < 90 and line[-1] not in ".,;" and len(text) > 400:
                found.append((name, page, p, text))
                name, page, text = line[:120], p, ""
            elif line:
                text += line + "\n"
        found.append((name, page, max(x[1] for x in mine), text))
        want += [(d, k, *f) for k, f in enumerate(found) if f[3].strip()]
    got = chunking.font_sections(spark.createDataFrame(rows, "doc_id int, page int, pos int, text string, sizes array<double>"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and len(want) > 8


def test_hybrid_looks_in_titles(spark):
    chunks = spark.createDataFrame([(1, 1, "Fiebre", "uno", "texto", [1.0, 0.0]), (2, 2, None, "Fiebre", "texto", [1.0, 0.0]), (3, 3, "x", "y", "texto", [1.0, 0.0])], "chunk_id int, parent_id int, title string, section string, text string, embedding array<double>")
    assert {r.chunk_id for r in retrieval.bm25(retrieval.keyword_field(chunks), spark.createDataFrame([(1, "fiebre")], "query_id int, text string")).collect()} == {1, 2}


def test_dense_by_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id int, embedding array<double>").repartition(2)
    got = retrieval.dense(vectors, spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "query_id int, embedding array<double>"), 5).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(20):
        want = sorted((round(1 - float(unit[q] @ unit[i]), 9) + 0.0, i) for i in range(60))[:5]
        mine = sorted((round(r.distance, 9) + 0.0, r.chunk_id) for r in got if r.query_id == q)
        assert [i for _, i in mine] == [i for _, i in want] or np.allclose([d for d, _ in mine], [d for d, _ in want], atol=1e-8)


def test_dense_passes_on_the_best_of_a_task_and_skips_far_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.array([centres[i % 40] + 0.05 * rng.normal(size=16) for i in range(6000)])
    x[:2000:2] = x[1]  # ties in a sixth of the rows
    vectors = spark.createDataFrame([(f"v{i:05}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 6000, 150)], "query_id int, embedding array<double>")
    (part,) = retrieval.passed(vectors, asked, 7)
    part = part.cache()
    assert part.where("chunk_id is not null").count() <= 3 * 40 * 7
    told = part.agg({"compared": "sum", "skipped": "sum"}).first().asDict()
    assert told["sum(skipped)"] > 0.45 * sum(told.values())
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = {}
    for r in retrieval.dense(vectors, asked, 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
    for i in range(0, 6000, 150):
        q = np.array(x[i])
        d = np.round(1 - unit @ (q / np.linalg.norm(q)), 9)
        assert [got[i][k] for k in range(1, 8)] == [f"v{j:05}" for j in np.lexsort((np.arange(6000), d))[:7]]


words = st.lists(st.text("ab.", min_size=1, max_size=4), min_size=1, max_size=120)


@settings(max_examples=50, suppress_health_check=list(HealthCheck), deadline=None)
@given(words, st.sampled_from(["\n\n", "\n", " "]))
def test_blocks_keep_words(found, joint):
    text = joint.join(found)
    (out,) = chunking.blocks([text], 10)
    assert " ".join(out).split() == text.split() and all(len(b.split()) <= 10 for b in out)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_children_overlap(sizes):
    sentences = [" ".join([f"w{i}x{'y' * 60}"] * n) for i, n in enumerate(sizes)]
    out = chunking.children_of(sentences, chunking.Tokens().sizes(sentences), 40, 10)
    covered = {w for c in out for w in c.split()}
    assert covered == {w for s in sentences for w in s.split()}
    for a, b in zip(out, out[1:], strict=False):
        assert b.split()[0] in a.split()


def test_sections_and_parents(spark):
    docs = spark.createDataFrame([("d", "f.md", "# One\ntext a\n## Index\nx\n### Two\n" + "word. " * 2500), ("e", "g.txt", "no heading")], "doc_id string, file string, text string")
    found = chunking.sections(docs)
    assert [r.section for r in found.where("doc_id = 'd'").orderBy("pos").collect()] == ["One", "Index", "Two"]
    assert found.where("doc_id = 'e'").first().section == "g.txt"
    names = [r.section for r in chunking.parents(found).where("doc_id = 'd'").orderBy("parent_id").collect()]
    assert names == ["One", "Two (1)", "Two (2)", "Two (3)", "Two (4)"]  # the heading is a line of its own


def test_outline(spark):
    marks = spark.createDataFrame([("d", 0, "A", 1), ("d", 1, "B", 3)], "doc_id string, pos int, title string, page int")
    pages = spark.createDataFrame([("d", i, f"p{i}") for i in range(1, 5)], "doc_id string, page int, text string")
    assert [(r.section, r.page_from, r.page_to, r.text) for r in chunking.outline_sections(marks, pages).orderBy("pos").collect()] == [("A", 1, 3, "p1\np2\np3"), ("B", 3, 4, "p3\np4")]


def test_hybrid_with_scenarios(spark):
    chunks = spark.createDataFrame([(1, 10, "Plan de cuidado", "fiebre alta", [1.0, 0.0], "a"), (2, 20, "Guide", "fever chart", [1.0, 0.1], "b"), (3, 10, "Plan de cuidado", "fiebre baja", [0.9, 0.1], "general"), (4, 30, "Other", "x y z", [0.0, 1.0], "a")], "chunk_id int, parent_id int, title string, text string, embedding array<double>, scenario string")
    parents = chunks.selectExpr("parent_id", "text").dropDuplicates(["parent_id"])
    queries = spark.createDataFrame([(7, "fiebre", [1.0, 0.0], "a"), (8, "zz", [-1.0, 0.0], "a")], "query_id int, text string, embedding array<double>, scenario string")
    free = retrieval.hybrid(chunks, parents, queries).where("query_id = 7").orderBy("n").collect()
    assert [r.parent_id for r in free] == [10, 20]
    bound = retrieval.hybrid(chunks, parents, queries, scenario=True).orderBy("n").collect()
    assert {r.query_id for r in bound} == {7} and 20 not in {r.parent_id for r in bound}


def test_sentences_keep_the_digits_of_their_places(spark):
    text = "0.5 begins it. 10 ends in 1! 2 and 2? Then 3"
    got = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t"))).first()[0]
    assert got == ["0.5 begins it.", "10 ends in 1!", "2 and 2?", "Then 3"]


def test_children_are_cut_in_bounded_slices():
    import pandas as pd

    texts = [[f"Sentence {i} of text {n} has some words here." for i in range(n % 60)] for n in range(500)]
    out = list(chunking._children(None).func(iter([pd.Series(texts)])))
    assert max(map(len, out)) <= 64 and sum(map(len, out)) == 500
    want = [chunking.children_of(s, chunking.Tokens().sizes(s)) for s in texts]
    assert [x for part in out for x in part] == want
    long = ["a" * 81 + " b", "", " x\n" + "y" * 40]
    assert chunking.Tokens().sizes(long).tolist() == [len(s) for s in chunking.Tokens().starts(long)]
