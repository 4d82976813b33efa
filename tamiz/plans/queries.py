"""Queries over the driver's tables, and the SQL that DuckDB answers them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import lexicon, speech
from tamiz.functions import text as T
from tamiz.operators import chunking, dialog, grounding, guards, metrics, records, retrieval, rules, similar, slots, speech_repair
from tamiz.session import table
from tamiz.sources import index, store
from tamiz.sources.versions import written
from tamiz.streaming import calls, machine, signal, windows

#: Items that are compared with every text at once.
SOME = 1000

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


FOLD = "strip_accents(lower({}))"
WORDS = "list_filter(regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[a-z0-9]{{2,}}'), lambda w: not list_contains([" + ", ".join(f"'{w}'" for w in sorted({*T.STOP_ES, *T.STOP_EN})) + "], w))"
COUNT = "(length({0}) - length(replace({0}, '{1}', ''))) // {2}"


def _sum(hay: str, words: list[str]) -> str:
    return " + ".join(COUNT.format(hay, w, len(w)) for w in words)


@query(f"select doc_id, len(w) as n_tokens, len(list_distinct(w)) as n_terms from (select doc_id, {WORDS.format('text')} as w from documents)")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_terms"))


@query(f"select doc_id, case when {_sum('t', T.ES_HINTS)} >= {_sum('t', T.EN_HINTS)} then 'es' else 'en' end as language from (select doc_id, ' ' || lower(text) || ' ' as t from documents)")
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


#: Frequent words of the driver's texts, so that scenarios differ there.
THEMES = {"first": ["tion", "ment"], "second": ["ing", "keit"], "third": ["ción", "lich"]}


def _themes_sql(themes: dict[str, list[str]]) -> str:
    scores = ", ".join(f"{_sum('t', words)} as {name}" for name, words in themes.items())
    best = f"greatest({', '.join(themes)})"
    cases = " ".join(f"when {name} = {best} then '{name}'" for name in themes)
    return f"select doc_id, case when {best} = 0 then 'general' {cases} end as scenario from (select doc_id, {scores} from (select doc_id, lower(source || ' ' || left(text, 5000)) as t from documents))"


@query(_themes_sql(T.SCENARIOS))
def detect_scenario(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.scenario(F.col("source"), F.col("text")).alias("scenario"))


@query(_themes_sql(THEMES))
def detect_theme(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.scenario(F.col("source"), F.col("text"), THEMES).alias("scenario"))


@query("select left(sha256(text), 16) as content_id, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1")
def doc_hash_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.groupBy(T.content_id(F.encode("text", "UTF-8")).alias("content_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(r"select min(doc_id) as doc_id, count(*) as copies from documents group by lower(left(regexp_replace(text, '[ \t\n\x0b\f\r]+', '', 'g'), 300))")
def near_dup_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(T.fingerprint(F.col("text")).alias("print")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("print")


@query(r"""
with parts as (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), '\n([A-ZÁÉÍÓÚÑ•-])', chr(1) || '\1', 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') as s from documents)
select doc_id, generate_subscripts(s, 1) - 1 as pos, unnest(s) as sentence from parts""")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


TOC = r"""
select doc_id, case when regexp_matches(text, '^\s*(index|contents)') then true else lines >= 8 and dotted / lines > 0.3 end as toc from (
  select doc_id, text, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) as lines,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\.{4,}\s*\d+\s*$'))) as dotted
  from (select doc_id, case when doc_id % 3 = 0 then regexp_replace(text, '\.', '..... 7', 'g') else text end as text from documents))"""


@query(TOC)
def toc_filter(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"\.", "..... 7")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.is_toc(F.when(text.rlike(r"^\s*(index|contents)"), "Index."), text).alias("toc"))


@query()
def parent_child_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file"), "text")
    return chunking.children(chunking.parents(chunking.sections(docs)), F.lit("title"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25 = f"""
words as (select doc_id as chunk_id, {WORDS.format('text')} as w from documents),
total as (select count(*) as n, avg(len(w)) as mean from words),
post as (select chunk_id, len, term, count(*) as tf from (select chunk_id, len(w) as len, unnest(w) as term from words) group by all),
asked as (select distinct item_id as query_id, unnest({WORDS.format('text')}) as term from benchmark),
df as (select term, count(*) as df from post group by term),
scored as (
  select query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))) as score
  from asked join df using (term) join post using (term), total group by all),
lexical as (select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from scored where score > 0) where rank <= 30)"""


@query(f"with {BM25} select query_id, chunk_id, round(score, 5) as score, rank from lexical")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.bm25(_chunks(spark, sf), _queries(spark, sf))
    return found.select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


CHANGED = """(select doc_id, case when lang = 'fr' then concat_ws(' ', text, source, lang) else text end as text from documents where doc_id not in (select doc_id from labels where toxic = 1)
  union all select 10000000 + item_id, text from benchmark)"""


@query(f"with {BM25.replace('from documents', f'from {CHANGED}')} select query_id, chunk_id, round(score, 5) as score, rank from lexical")
def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 from a stored index: built, then the documents of one language change and the items come in, then those that are
    labelled toxic are forgotten."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    stored = index.built(spark, _chunks(spark, sf))
    changed = docs.where("lang = 'fr'").select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", "text", "source", "lang").alias("text"))
    stored.upsert(changed.unionByName(items.select((F.col("item_id") + 10000000).alias("chunk_id"), "text")))
    stored.forget(table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")))
    return stored.search(_queries(spark, sf)).select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with the ids of benchmark items stand for their query vectors."""
    ids = table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"))
    return table(spark, sf, "embeddings").join(ids, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("wanted"))


DENSE = """
pairs as (
  select q.vec_id as query_id, q.label as wanted, v.vec_id as chunk_id, v.label,
    1 - list_dot_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))) as distance
  from embeddings v, embeddings q where q.vec_id in (select item_id from benchmark)),
nearest as (select query_id, chunk_id, distance, rank from (select *, row_number() over (partition by query_id order by round(distance, 9), chunk_id) as rank from pairs) where rank <= 30)"""


@query(f"with {DENSE} select query_id, chunk_id, round(greatest(distance, 0), 5) as distance, rank from nearest")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense(_vectors(spark, sf), _asked(spark, sf)).select("query_id", "chunk_id", F.round(F.greatest("distance", F.lit(0.0)), 5).alias("distance"), "rank")


@query(f"with {DENSE} select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by round(distance, 9), chunk_id) as rank from pairs where label = wanted or label = 0) where rank <= 5")
def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Labels stand for scenarios; 0 is the general one."""
    name = lambda c: F.when(F.col(c) == 0, "general").otherwise(F.col(c).cast("string"))
    vectors = _vectors(spark, sf).withColumn("scenario", name("label"))
    asked = _asked(spark, sf).withColumn("scenario", name("wanted"))
    return retrieval.dense(vectors, asked, 5).select("query_id", "chunk_id", "rank")


@query(f"with {DENSE} select query_id, min(distance) <= 0.6 as passes from nearest where rank > 1 group by query_id")
def relevance_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which queries pass by the nearest vector that is not their own."""
    near = retrieval.dense(_vectors(spark, sf), _asked(spark, sf)).where("rank > 1")
    every = near.select("query_id").distinct()
    passed = retrieval.gate(every, near, 0.6).withColumn("passes", F.lit(True))
    return every.join(passed, "query_id", "left").select("query_id", F.coalesce("passes", F.lit(False)).alias("passes"))


FUSED = f"""{BM25}, {DENSE},
fused as (
  select query_id, chunk_id, sum(1.0 / (60 + rank)) as score, max(l) as lexical_rank, max(d) as dense_rank
  from (select query_id, chunk_id, rank, rank as l, null as d from lexical union all select query_id, chunk_id, rank, null, rank from nearest) group by all)"""


@query(f"with {FUSED} select query_id, chunk_id, round(score, 9) as score, lexical_rank, dense_rank from fused")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    both = retrieval.fused(retrieval.bm25(_chunks(spark, sf), _queries(spark, sf)), retrieval.dense(_vectors(spark, sf), _asked(spark, sf)))
    return both.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "lexical_rank", "dense_rank")


#: BM25 over title and text, and vectors of stored documents alone.
TITLED = "case when source in ('src1', 'src2') then 'Plan de cuidado' else source end || ' ' || text"
STORED = FUSED.replace(WORDS.format("text") + " as w from documents", WORDS.format(TITLED) + " as w from documents").replace("from embeddings v,", "from (select * from embeddings where vec_id in (select doc_id from documents)) v,")
HYBRID = rf"""with {STORED},
gated as (select query_id from nearest group by query_id having min(distance) > 0.42),
hits as (
  select f.query_id, f.chunk_id, d.text, f.lexical_rank, f.dense_rank, f.score * case when d.source in ('src1', 'src2') then 1.6 else 1 end as score
  from fused f join documents d on d.doc_id = f.chunk_id where f.query_id not in (select query_id from gated)),
cut as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, lexical_rank nulls last, dense_rank nulls last) as rank from hits) where rank <= 6),
one as (select * from (select *, row_number() over (partition by query_id, lower(left(regexp_replace(text, '[ \t\n\x0b\f\r]+', '', 'g'), 300)) order by rank) as first from cut) where first = 1)
select query_id, n, chunk_id, round(score, 9) as score from (select *, row_number() over (partition by query_id order by rank) as n from one) where n <= 2"""


@query(HYBRID)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item as a query; a document is its own parent, two sources stand for patient documents."""
    docs = table(spark, sf, "documents")
    title = F.when(F.col("source").isin("src1", "src2"), "Plan de cuidado").otherwise(F.col("source"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = docs.join(vectors, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("parent_id"), title.alias("title"), "text", "embedding")
    chunks = written(chunks, "chunks")  # read four times
    asked = _queries(spark, sf).join(_asked(spark, sf).drop("wanted"), "query_id", "left")
    found = retrieval.hybrid(chunks, chunks.select("parent_id", "text"), asked)
    return found.select("query_id", "n", "chunk_id", F.round("score", 9).alias("score"))


@query()
def small_to_big(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by keywords, then the first hit of each parent block and of each parent text."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file"), "text")
    parents = written(chunking.parents(chunking.sections(docs)), "parents")
    chunks = written(chunking.children(parents, F.lit("")).select("chunk_id", "parent_id", "text"), "chunks")
    hits = retrieval.bm25(chunks.select("chunk_id", "text"), _queries(spark, sf)).join(chunks.select("chunk_id", "parent_id"), "chunk_id")
    found = retrieval.sources(hits, parents.select("parent_id", "text"), 6)
    return found.select("query_id", "n", "parent_id", "chunk_id", F.round("score", 5).alias("score"))


@query(r"""
select b.item_id, d.doc_id, case when length(d.text) <= 700 then d.text when pos < 0 then left(d.text, 700)
  else case when greatest(0, pos - 175) > 0 then '…' else '' end || substr(d.text, greatest(0, pos - 175) + 1, 700) || '…' end as excerpt
from benchmark b, lateral (select doc_id, text, instr(text, left(b.text, 80)) - 1 as pos from documents) d where d.doc_id = b.item_id or pos >= 0""")
def context_window(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with an item's id, and those that hold its first 80 characters: a whole word inside them finds the candidates."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("hit"), F.left("text", F.lit(80)).alias("start")).where("start is not null")
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    # words between two white spaces of the characters; the first and the last may be parts of longer ones in a text
    inner = F.split(F.regexp_replace(F.regexp_replace("start", r"^\S*\s+", ""), r"\s+\S*$", ""), r"\s+")
    has = F.col("start").rlike(r"\s\S+\s")
    keyed = items.where(has).withColumn("word", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    words = docs.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    found = words.join(keyed, "word").where(F.contains("text", F.col("start"))).select("item_id", "doc_id", "text", "hit")
    # items without such a word are looked for in each text, so many at once
    without = items.where(~has)
    parts = -(-without.count() // SOME)
    for part in range(parts):
        some = F.broadcast(without.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part))
        found = found.unionByName(docs.join(some, F.contains("text", F.col("start"))).select("item_id", "doc_id", "text", "hit"))
    whole = table(spark, sf, "documents").select("doc_id", "text")
    same = whole.join(items, F.col("doc_id") == F.col("item_id")).where(~F.coalesce(F.contains("text", F.col("start")), F.lit(False))).select("item_id", "doc_id", "text", "hit")
    return found.unionByName(same).select("item_id", "doc_id", T.window(F.col("text"), F.col("hit"), 700).alias("excerpt"))


@query()
def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.element_at(F.array(*map(F.lit, ["fiebre", "wound care", "dolor de rodilla", "shower", ""])), (F.col("item_id") % 5 + 1).cast("int"))
    return table(spark, sf, "benchmark").select("item_id", lexicon.expanded(F.concat_ws(" ", mark, "text")).alias("expanded"))


@query("select event_type, quantile_disc(value, 0.5) is not null as some, round(list_sort(list(value))[least(count(value) - 1, round_even(0.95 * (count(value) - 1), 0)::bigint) + 1], 2) as p95 from events group by event_type".replace("quantile_disc(value, 0.5) is not null as some", "round(median(value), 2) as p50"))
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.percentiles(table(spark, sf, "events"), "value", 0.95, "event_type")
    return found.select("event_type", F.round("median", 2).alias("p50"), F.round("ranked", 2).alias("p95"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Events as turns of calls: a user is a call, and its value stands for the numbers that a log line has."""
    amount = F.floor("value").cast("long")
    return table(spark, sf, "events").select(F.col("user_id").alias("call_id"), amount.alias("tokens_in"), F.when(amount % 3 > 0, amount % 50).alias("tokens_out"), (amount % 4).alias("llm_calls"), F.when(amount % 5 == 0, 1).alias("rag_queries"))


TURNS = "turns as (select user_id as call_id, floor(value)::bigint as tokens_in, case when floor(value)::bigint % 3 > 0 then floor(value)::bigint % 50 end as tokens_out, floor(value)::bigint % 4 as llm_calls, case when floor(value)::bigint % 5 = 0 then 1 end as rag_queries from events)"
ROLLUP = f"""{TURNS}, rollup as (
  select count(*) as turns, count(distinct call_id) as calls, round(sum(tokens_in)::double / count(*), 1) as tokens_in_per_turn, round(sum(coalesce(tokens_out, 0))::double / count(*), 1) as tokens_out_per_turn,
    round(sum(llm_calls)::double / count(*), 2) as model_calls_per_turn, round(sum(coalesce(rag_queries, 0))::double / count(distinct call_id), 2) as searches_per_call,
    round(sum(tokens_in + coalesce(tokens_out, 0))::double / count(distinct call_id), 1) as tokens_per_call from turns)"""


@query(f"with {ROLLUP} select * from rollup")
def call_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.call_rollup(_turns(spark, sf))


@query(f"with {ROLLUP}, tariffs(name, usd_in, usd_out) as (values ('small', 0.15, 0.6), ('large', 2.5, 10.0)) select name, round(tokens_per_call * (tokens_in_per_turn / (tokens_in_per_turn + tokens_out_per_turn) * usd_in::double + (1 - tokens_in_per_turn / (tokens_in_per_turn + tokens_out_per_turn)) * usd_out::double) / 1e6, 6) as usd_per_call from tariffs, rollup")
def llm_cost(spark: SparkSession, sf: str) -> DataFrame:
    tariffs = spark.createDataFrame([("small", 0.15, 0.6), ("large", 2.5, 10.0)], "name string, usd_in double, usd_out double")
    return metrics.cost(metrics.call_rollup(_turns(spark, sf)), tariffs)


@query("select conv_id, min_by(role, turn) as first_role, min_by(text, turn) as first_text, max_by(text, turn) as last_text from conversations group by conv_id")
def case_first(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.min_by("text", "turn").alias("first_text"), F.max_by("text", "turn").alias("last_text"))


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Two labels as an expected level, the length of a text as a predicted one."""
    level = lambda c: F.element_at(F.array(*map(F.lit, rules.LEVELS)), c + 1)
    docs = table(spark, sf, "documents").select("doc_id", F.pmod("n_chars", F.lit(3)).cast("int").alias("p"))
    return table(spark, sf, "labels").join(docs, "doc_id").select(level(F.col("quality") + F.col("toxic")).alias("expected"), level(F.col("p")).alias("predicted"))


PREDICTED = "p as (select ['verde', 'amarillo', 'rojo'][quality + toxic + 1] as expected, ['verde', 'amarillo', 'rojo'][n_chars % 3 + 1] as predicted, quality + toxic as e, n_chars % 3 as g from labels join documents using (doc_id))"


@query(f"with {PREDICTED} select expected, count(*) filter (where g = 0) as verde, count(*) filter (where g = 1) as amarillo, count(*) filter (where g = 2) as rojo from p group by expected")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_predicted(spark, sf), "expected", "predicted", rules.LEVELS)


@query(f"with {PREDICTED} select count(*) as cases, count(*) filter (where g < e) as too_low, count(*) filter (where e = 2) as top_cases, round(count(*) filter (where e = 2 and g = 2)::double / greatest(count(*) filter (where e = 2), 1), 6) as top_recall from p")
def recall_and_misses(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.misses(_predicted(spark, sf), "expected", "predicted", rules.LEVELS)


@query("select c_custkey, c_name, coalesce(n_name, '') as nation from customer left join nation on c_nationkey = n_nationkey")
def title_lookup(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(nations, "c_nationkey", "left").select("c_custkey", "c_name", F.coalesce("n_name", F.lit("")).alias("nation"))


@query("select o_custkey, c_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by all")
def patients_join(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return sums.join(people, "o_custkey").select("o_custkey", "c_name", "orders", "total")


def _symptoms(spark: SparkSession, sf: str) -> DataFrame:
    """Clinical turns made of events: the driver's texts have no clinical words."""
    v = F.floor(F.col("value") * 100).cast("long")
    pick = lambda order, x: F.try_element_at(F.array(*map(F.lit, order)), (x + 1).cast("int"))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    flag = lambda n: F.when(v % n == 0, True).when(v % n == 1, False)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("call_id"), turn.alias("turn"), F.when(v % 7 < 2, (v % 11).cast("double")).alias("pain"),
        F.when(v % 13 < 2, 33.0 + (v % 120) / 10.0).alias("fever"), flag(211).alias("fever_felt"), pick(rules.WOUND, v % 97).alias("wound"),
        flag(101).alias("pain_worse"), flag(307).alias("bleeding"), flag(311).alias("dyspnoea"), flag(313).alias("vomiting"),
        pick(rules.APPETITE, v % 41).alias("appetite"), F.when(v % 37 == 0, "alterado").when(v % 37 == 1, "normal").alias("sleep"),
        (v % 23 == 0).alias("mentioned"), (v % 29 == 0).alias("minimises"),
        F.when(v % 401 == 0, F.array(F.lit("Escalofrío"))).when(v % 401 == 1, F.array(F.lit("me desmayé"))).otherwise(F.array().cast("array<string>")).alias("others"),
    )


SYMPTOMS = """
e as (select user_id as call_id, row_number() over (partition by user_id order by ts, event_id) as turn, floor(value * 100)::bigint as v from events),
raw as (select call_id, turn, case when v % 7 < 2 then (v % 11)::double end as pain, case when v % 13 < 2 then 33.0 + (v % 120) / 10.0 end as f, case when v % 211 = 0 then true when v % 211 = 1 then false end as ff,
  case when v % 97 < 7 then v % 97 end as wound, case when v % 101 = 0 then true when v % 101 = 1 then false end as pain_worse, case when v % 307 = 0 then true when v % 307 = 1 then false end as bleeding,
  case when v % 311 = 0 then true when v % 311 = 1 then false end as dyspnoea, case when v % 313 = 0 then true when v % 313 = 1 then false end as vomiting,
  case when v % 41 < 2 then v % 41 end as appetite, case when v % 37 = 0 then 'alterado' when v % 37 = 1 then 'normal' end as sleep, v % 23 = 0 as mentioned, v % 29 = 0 as minimises, v % 401 = 0 as chill, v % 401 = 1 as faint from e),
turns as (select *, case when f between 34.0 and 43.0 then f end as fever, case when f is not null and not f between 34.0 and 43.0 then true else ff end as fever_felt,
  case when pain is not null then false when mentioned then true end as event from raw),
state as (select call_id, turn, max(pain) over w as pain, max(fever) over w as fever, bool_or(fever_felt) over w as fever_felt, max(wound) over w as wound, bool_or(pain_worse) over w as pain_worse, bool_or(bleeding) over w as bleeding,
  bool_or(dyspnoea) over w as dyspnoea, bool_or(vomiting) over w as vomiting, max(appetite) over w as appetite, last_value(sleep ignore nulls) over w as sleep, coalesce(last_value(event ignore nulls) over w, false) as unquantified,
  (sum(minimises::int) over w)::int as minimising, bool_or(chill) over w as chill, bool_or(faint) over w as faint
  from turns window w as (partition by call_id order by turn rows unbounded preceding))"""


@query(f"with {SYMPTOMS} select call_id, turn, pain, round(fever, 1) as fever, fever_felt, ['normal', 'enrojecida_leve', 'enrojecida', 'hinchada', 'secrecion_clara', 'secrecion_purulenta', 'abierta'][wound + 1] as wound, pain_worse, bleeding, dyspnoea, vomiting, ['reducido', 'nulo'][appetite + 1] as appetite, sleep, unquantified, minimising, chill::int + faint::int as n_others from state")
def monotone_symptoms(spark: SparkSession, sf: str) -> DataFrame:
    state = rules.running_state(_symptoms(spark, sf))
    return state.withColumn("fever", F.round("fever", 1)).withColumn("n_others", F.size("others")).drop("others")


LEVEL = f"""{SYMPTOMS},
soft as (select *, (coalesce(wound between 1 and 4, false))::int + (coalesce(fever_felt and fever is null, false) or coalesce(fever >= 37.8 and fever < 38.0, false))::int + (appetite is not null)::int + (coalesce(sleep = 'alterado', false))::int
  + (unquantified and pain is null and minimising >= 1)::int as soft from state),
level as (select call_id, turn, case when fever >= 38.5 or pain >= 8 or wound >= 5 or bleeding or dyspnoea or vomiting or faint or soft >= 3 then 2
  when fever >= 38.0 or pain >= 5 or (pain is null and pain_worse) or wound between 2 and 4 or chill or soft = 2 then 1 else 0 end as level from soft)"""


@query(f"with {LEVEL} select call_id, turn, ['verde', 'amarillo', 'rojo'][level + 1] as level, ['verde', 'amarillo', 'rojo'][max(level) over (partition by call_id order by turn rows unbounded preceding) + 1] as call_level from level")
def triage_levels(spark: SparkSession, sf: str) -> DataFrame:
    state = rules.running_state(_symptoms(spark, sf))
    evaluated = state.withColumn("found", rules.evaluate(state)).select("call_id", "turn", F.col("found.level").alias("level"))
    return rules.running_level(evaluated)


@query()
def triage_reasons(spark: SparkSession, sf: str) -> DataFrame:
    state = rules.running_state(_symptoms(spark, sf))
    return state.withColumn("found", rules.evaluate(state)).select("call_id", "turn", "found.*")


@query(f"""with {SYMPTOMS}, pairs as (select *, lag(pain) over (partition by call_id order by turn) as p2, lag(fever) over (partition by call_id order by turn) as f2, lag(sleep) over (partition by call_id order by turn) as s2, lag(bleeding) over (partition by call_id order by turn) as b2 from turns)
select call_id, turn, greatest(pain, p2) as pain, round(greatest(fever, f2), 1) as fever, coalesce(sleep, s2) as sleep, case when bleeding or b2 then true else coalesce(bleeding, b2) end as bleeding from pairs""")
def worst_of_merge(spark: SparkSession, sf: str) -> DataFrame:
    turns = _symptoms(spark, sf)
    turns = turns.withColumn("fever", F.when(F.col("fever").between(34.0, 43.0), F.col("fever")))
    names = ["pain", "fever", "sleep", "bleeding"]
    w = Window.partitionBy("call_id").orderBy("turn")
    pairs = turns.select("call_id", "turn", *names, *(F.lag(n).over(w).alias(f"{n}_2") for n in names))
    out = rules.worst({n: F.col(n) for n in names}, {n: F.col(f"{n}_2") for n in names})
    return pairs.select("call_id", "turn", *((F.round(c, 1) if n == "fever" else c).alias(n) for n, c in out.items()))


#: Sayings that rules are tried on, with what they say (fixtures, dealt over the conversations).
SAYINGS = ["tengo treinta y nueve de fiebre", "me duele siete de diez", "nada de pus", "no me sale pus, bueno ahora sí me salió pus amarillo", "mi hijo tiene 39 de fiebre", "mi hija dice que tengo 39 de fiebre", "fiebre desde hace treinta y seis horas", "dos pastillas cada ocho horas para el dolor", "sin sangrado", "todo bien"]


#: What the sayings make known; of the turns' own texts words of a worsening are met with, and a number's name right after a saying about pain.
SAID = """
with want(k, fever, fever_felt, pain, alarm) as (values (0, 39.0, null, null, null), (1, null, null, 7.0, null), (3, null, null, null, 'pus'), (5, 39.0, null, null, null), (6, null, true, null, null))
select conv_id, turn, fever::double as fever, fever_felt::boolean as fever_felt, coalesce(pain::double, case when (conv_id + turn) % 10 = 7 then nullif(list_position(['cero', 'uno', 'dos', 'tres', 'cuatro', 'cinco', 'seis', 'siete', 'ocho', 'nueve', 'diez'], replace(regexp_extract(strip_accents(lower(text)), '^[^0-9]{0,16}?\\b(cero|un[oa]|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez)\\b', 1), 'una', 'uno')), 0) - 1 end)::double as pain, case when regexp_matches(strip_accents(lower(text)), 'empeor|aument|va subiendo|mas fuerte|cada vez peor') then true end as pain_worse, null::boolean as dyspnoea, null::boolean as bleeding, alarm
from conversations left join want on k = (conv_id + turn) % 10"""


@query(SAID)
def symptom_extraction(spark: SparkSession, sf: str) -> DataFrame:
    saying = F.element_at(F.array(*map(F.lit, SAYINGS)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(SAYINGS))) + 1).cast("int"))
    text = F.concat_ws(". ", saying, "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", speech.extracted(text).alias("x"), rules.quick_red(text).alias("alarm")).select("conv_id", "turn", "x.*", "alarm")


@query("select conv_id, turn, role, last_value(case when role = 'assistant' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as last_agent from conversations")
def last_agent_message(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "assistant", F.col("text")), True).over(w).alias("last_agent"))


@query("select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn) as a, row_number() over (partition by conv_id order by turn desc) as z, count(*) over (partition by conv_id) as n from conversations) where n <= 9 or a = 1 or z <= 8")
def history_prune(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.pruned(table(spark, sf, "conversations"), "conv_id").select("conv_id", "turn", "text")


OVERLAP = "list_distinct(regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[a-z]{{3,}}'))"


@query(f"""with t as (select conv_id, turn, {OVERLAP.format('text')} as w, lag({OVERLAP.format('text')}) over (partition by conv_id order by turn) as p from conversations)
select conv_id, turn, round(case when len(w) > 0 then len(list_intersect(w, p))::double / len(w) end, 6) as overlap from t where p is not null""")
def word_overlap(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(T.fold(F.coalesce("text", F.lit(""))), F.lit("([a-z]{3,})"), F.lit(1)))
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("w")).withColumn("p", F.lag("w").over(w)).where("p is not null")
    return turns.select("conv_id", "turn", F.round(F.when(F.size("w") > 0, F.size(F.array_intersect("w", "p")) / F.size("w")), 6).alias("overlap"))


@query("select user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') as kinds, array_to_string(list_sort(list_distinct(list(event_type) filter (where value < 100))), ',') as low, array_to_string(list_sort(list_filter(list_distinct(list(event_type)), lambda x: not list_contains(coalesce(list_distinct(list(event_type) filter (where value < 100)), []), x))), ',') as only_high from events group by user_id")
def reasons_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"), F.collect_set(F.when(F.col("value") < 100, F.col("event_type"))).alias("l"))
    text = lambda c: F.array_join(F.sort_array(c), ",")
    low = F.when(F.size("l") > 0, text(F.col("l")))
    return sets.select("user_id", text(F.col("k")).alias("kinds"), low.alias("low"), text(F.array_except("k", "l")).alias("only_high"))


@query("""with g as (select user_id, ts, event_id, case when epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id) <= 3600 then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
select user_id, session::bigint as session, min(ts) as started, max(ts) as ended, count(*) as n from s group by user_id, session""")
def speech_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return calls.sessions(table(spark, sf, "events"), 3600)


@query("select user_id, event_id, nudges from (select user_id, event_id, least(3, floor((lead(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id) - epoch_us(ts) / 1e6) / 600))::int as nudges from events) where nudges > 0")
def silence_nudges(spark: SparkSession, sf: str) -> DataFrame:
    return calls.nudges(table(spark, sf, "events"), 600)


@query("select event_type, time_bucket(interval '1 hour', ts) as starts, time_bucket(interval '1 hour', ts) + interval '1 hour' as ends, count(*) as n, sum(floor(value * 100)::bigint)::bigint as cents from events group by all")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by the hour; the same call over a stream waits for the watermark (tests/test_windows.py)."""
    return windows.windows(table(spark, sf, "events"), "1 hour", cents=F.floor(F.col("value") * 100).cast("long"))


@query("""select event_type, starts, starts + interval '1 hour' as ends, count(*) as n
from (select event_type, ts, unnest(range(time_bucket(interval '15 minutes', ts) - interval '45 minutes', time_bucket(interval '15 minutes', ts) + interval '1 minute', interval '15 minutes')) as starts from events) group by all""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.windows(table(spark, sf, "events"), "1 hour", "15 minutes")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '2 hours' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as spell from g)
select user_id, min(ts) as starts, max(ts) + interval '2 hours' as ends, count(*) as n from s group by user_id, spell""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.spells(table(spark, sf, "events"), "2 hours")


@query("""with a as (select event_type, ts, epoch_us(ts) / 1e6 as s, event_id % 3 as batch from events),
m as (select batch, max(max(s) - 86400) over (order by batch rows between unbounded preceding and 1 preceding) as mark from a group by batch)
select event_type, count(*) filter (where not coalesce(s < mark, false)) as on_time, count(*) filter (where coalesce(s < mark, false)) as late from a join m using (batch) group by event_type""")
def late_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as if they came in three batches, a day's delay allowed."""
    arrived = table(spark, sf, "events").withColumn("batch", F.pmod("event_id", F.lit(3)))
    return windows.late_counts(windows.late(arrived, 86400))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, json_extract(props, '$.missing') is null as missing from events")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("props", "k long, missing string")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), parsed["missing"].isNull().alias("missing"))


@query("select doc_id, source, n_chars::double as ts from documents")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The stored documents, newest first; their length stands for a time."""
    return store.manifest(table(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("ts")))


@query("select vec_id as doc_id, coalesce(source, vec_id::varchar) as title, source is not null as there from embeddings left join documents on vec_id = doc_id")
def source_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of documents by their vectors' ids, and whether the documents are stored."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return store.known(docs, store.titled(ids, docs)).select("doc_id", "title", "there")


@query("select doc_id, lang, n_chars from documents where doc_id % 10 <> 3 union all select doc_id, 'xx', n_chars + 1 from documents where doc_id % 10 = 3 union all select doc_id + 10000000, 'new', n_chars from documents where doc_id % 50 = 0")
def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    changed = docs.where("doc_id % 10 = 3").select("doc_id", F.lit("xx").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"))
    added = docs.where("doc_id % 50 = 0").select((F.col("doc_id") + 10000000).alias("doc_id"), F.lit("new").alias("lang"), "n_chars")
    return store.replaced(docs, changed.unionByName(added))


@query("select doc_id, source, n_chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)")
def forget_documents(spark: SparkSession, sf: str) -> DataFrame:
    return store.forgotten(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), table(spark, sf, "labels").where("toxic = 1"))


PAGES = """
marks as (select o_custkey as doc_id, o_orderkey as pos, left(o_orderpriority, 120) as section, row_number() over (partition by o_custkey order by o_orderkey) // 2 + 1 as page_from from orders),
spans as (select doc_id, pos, section, page_from, coalesce(lead(page_from) over (partition by doc_id order by pos), 20) as page_to from marks)"""


@query(f"with {PAGES} select doc_id, pos, section, page_from::int as page_from, page_to::int as page_to, (select string_agg('p' || p || case when p % 3 = 0 then ' ' || doc_id else '' end, chr(10) order by p) from range(page_from, page_to + 1) t(p)) as text from spans where page_from <= page_to")
def section_lead(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of an outline: a customer is a document of 20 pages, an order a mark."""
    orders = table(spark, sf, "orders")
    page = F.floor(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) / 2).cast("int") + 1
    marks = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("title"), page.alias("page"))
    pages = orders.select(F.col("o_custkey").alias("doc_id")).distinct().withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(20))))
    text = F.concat(F.lit("p"), F.col("page").cast("string"), F.when(F.col("page") % 3 == 0, F.concat(F.lit(" "), F.col("doc_id").cast("string"))).otherwise(""))
    return chunking.outline_sections(marks, pages.withColumn("text", text))


@query("select p.page_id, length(regexp_replace(p.html, '<[^>]*>', '', 'g')) as n_chars, regexp_extract(p.html, '<title>([^<]*)', 1) as title from pages p")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).alias("n_chars"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))


#: Questions and answers for the slot rules, dealt over the conversations.
ANSWERS = [("¿Cómo ha estado el dolor?", "el dolor está en seis"), ("¿Cuál es su temperatura?", "treinta y ocho punto cinco"), ("¿Cómo está la herida?", "sin secreción, un poco roja"), ("¿Y el apetito?", "no tengo apetito"), ("¿Me quedó claro?", "sí, quedó claro"), ("¿Cuál es su temperatura?", "nada de fiebre"), ("¿Cómo ha estado el dolor?", "mm")]


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda k: F.element_at(F.array(*(F.lit(a[k]) for a in ANSWERS)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(ANSWERS))) + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", pick(0).alias("question"), pick(1).alias("answer"))


#: What the fixtures say, worked out by hand, in their order.
K = "(conv_id + turn) % 7"
SLOTS = f"""
with want(k, slot, status, pain, fever, wound, appetite, no_fever, reply, confirmed) as (values
  (0, 'dolor', 'filled', 6.0, null, null, null, null, 'De acuerdo, el dolor está en 6.', null), (1, 'fiebre', 'filled', null, 38.5, null, null, null, 'De acuerdo, 38.5 grados.', null),
  (2, 'herida', 'filled', null, null, 'enrojecida', null, null, 'De acuerdo.', null), (3, 'apetito_sueno', 'filled', null, null, null, 'nulo', null, 'De acuerdo.', null),
  (4, 'confirmacion', 'open', null, null, null, null, null, 'De acuerdo.', 'Sí, quedó claro.'), (5, 'fiebre', 'filled', null, null, null, null, true, 'De acuerdo, sin fiebre.', null),
  (6, 'dolor', 'unclear', null, null, null, null, null, 'De acuerdo.', null))
select conv_id, turn, slot, status, pain::double as pain, fever::double as fever, wound, appetite, no_fever, reply, confirmed from conversations join want on k = {K}"""


@query(SLOTS)
def slot_parsing(spark: SparkSession, sf: str) -> DataFrame:
    turns = _answers(spark, sf).withColumn("slot", slots.asked(F.col("question")))
    turns = turns.withColumn("got", slots.parsed(F.col("slot"), F.col("answer")))
    return turns.select("conv_id", "turn", "slot", "got.*", slots.acknowledged(F.col("slot"), F.col("got")).alias("reply"), slots.confirmed(F.col("answer"), F.col("question")).alias("confirmed"))


@query(f"select conv_id, turn, case {K} when 0 then 6 when 1 then 5 end as number, {speech_repair.ALOUD[:30]}[turn + 1] || ' de treinta y ocho punto cinco' as aloud from conversations")
def spoken_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("conv_id", "turn", slots.spoken_number(F.col("answer")).alias("number"), speech_repair.spoken(F.concat_ws(" ", F.col("turn").cast("string"), F.lit("de 38.5"))).alias("aloud"))


@query("select conv_id, turn, case when turn % 2 = 0 then 'tengo fiebre y hinchazón' else 'la herida está bien' end as repaired from conversations")
def fuzzy_repair(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("turn") % 2 == 0, "tengo fierebres y sin chasón").otherwise("la erida está bien")
    return table(spark, sf, "conversations").select("conv_id", "turn", speech_repair.repaired(said).alias("repaired"))


#: Answers as a recogniser writes them, with the slot that was asked for, and what they are taken for.
MISHEARD = [
    ("cita", "es el próximo saludo", "el próximo sábado"), ("medicacion", "el cielo sigo tomando", "Sí, me los sigo tomando."), ("animo", "muy animado", "Bien, animado."), ("animo", "bien mal", "Mal, desanimado."),
    ("apetito_sueno", "¿Cómo bien?", "Como bien."), ("cierre", "a dios doctora", "adiós doctora"), ("herida", "tiene enchazón", "tiene hinchazón"), ("fiebre", "treinta y ocho", "Tengo 38 grados."), ("fiebre", "nada", "No he tenido fiebre."), ("", "tal cual", "tal cual"),
]


def _dealt(spark: SparkSession, sf: str, rows: list[tuple], *names: str) -> DataFrame:
    """The conversations' turns, each with one of the fixture rows."""
    pick = F.element_at(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, row, strict=True))) for row in rows)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(rows))) + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", pick.alias("x")).select("conv_id", "turn", "x.*")


def _quoted(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"


def _wanted(rows: list[tuple], *names: str) -> str:
    """SQL for the fixtures' results, the last fields of each row."""
    values = ", ".join(f"({k}, {', '.join(map(_quoted, row[-len(names):]))})" for k, row in enumerate(rows))
    return f"with want(k, {', '.join(names)}) as (values {values}) select conv_id, turn, {', '.join(names)} from conversations join want on k = (conv_id + turn) % {len(rows)}"


@query(_wanted(MISHEARD, "repaired"))
def slot_repairs(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt(spark, sf, [r[:2] for r in MISHEARD], "slot", "answer").select("conv_id", "turn", slots.repaired(F.col("slot"), F.col("answer")).alias("repaired"))


#: Replies of an assistant, and how they are said.
REPLIES = [
    ("Mauricio, le habla Elena. ¿Cómo sigue?", "¿Cómo sigue?"), ("Ana, le habla Elena. Hola Ana, le habla Elena. Siga así", "Siga así"), ("Bien. Luis, le habla Elena. Descanse", "Bien. Descanse"),
    ("Si tienes fiebre, puedes llamar a tu médico", "Si tiene fiebre, puede llamar a su médico"), ("¿Estás bien? Tu herida y tú", "¿Estás bien? Su herida y usted"), ("", ""),
]


@query(_wanted(REPLIES, "reply"))
def formal_replies(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt(spark, sf, [r[:1] for r in REPLIES], "text").select("conv_id", "turn", slots.formal(slots.introduced_once(F.col("text"), "Elena")).alias("reply"))


#: What a recogniser hands over; how it is taken; whether it asks; whether it is worth extracting from.
HEARD = [
    ("unos treinta y ocho grados?", "unos treinta y ocho grados.", False, True), ("¿puedo bañarme?", "¿puedo bañarme?", True, True), ("tengo dolor", "tengo dolor", False, True), ("¿Cómo bien?", "¿Cómo bien?", False, True),
    ("Gracias.", "", False, False), ("…", "", False, False), ("sí señora", "sí señora", False, False), ("es normal que salga líquido de la herida?", "es normal que salga líquido de la herida?", True, True),
    ("una frase mucho más larga de lo que cabe en tan poco tiempo", "", False, False), ("quiero saber cuándo vuelvo", "quiero saber cuándo vuelvo", True, False),
]


@query(_wanted(HEARD, "heard", "asks", "worth"))
def turn_guards(spark: SparkSession, sf: str) -> DataFrame:
    heard = _dealt(spark, sf, [r[:1] for r in HEARD], "text").withColumn("heard", guards.settled(guards.heard(F.col("text"), F.lit(2.0))))
    return heard.select("conv_id", "turn", "heard", guards.asks(F.col("heard")).alias("asks"), guards.worth_extracting(F.col("heard")).alias("worth"))


#: What was said, what was heard, what was replied, and the issues of that turn.
TURNS_CHECKED = [
    ("tengo fiebre alta", "tengo fiebre alta", "¿Cuánto marcó?", ""), ("tengo fiebre alta", "", "Bien", "STT vacío o ausente"), ("tengo fiebre alta", "la casa", "Bien", "STT muy distinto de lo dicho: «la casa»"),
    ("sí", "no", "¿Puedes venir? ¿Cuándo?", "Posible tuteo en respuesta;Más de una pregunta en el turno"), ("sí", "sí", "Gracias por compartir eso", "Fórmula poco natural: gracias por compartir"),
    ("sí", "sí", "Por lo que me cuenta, hoy. Por lo que me cuenta, ya.", "Protocolo de alerta duplicado en el mismo texto"), ("sí", "sí", None, ""),
]


@query(_wanted(TURNS_CHECKED, "issues"))
def reply_checks(spark: SparkSession, sf: str) -> DataFrame:
    turns = _dealt(spark, sf, [r[:3] for r in TURNS_CHECKED], "said", "heard", "reply")
    return turns.select("conv_id", "turn", F.array_join(guards.reply_issues(F.col("said"), F.col("heard"), F.col("reply")), ";").alias("issues"))


BATTERY = """
with calls as (select user_id as call_id, min(value) >= 1 as ok, count(*) filter (where value < 5) as spurious from events group by user_id)
select count(*) as total, count(*) filter (where ok) as ok, count(*) filter (where not ok) as fail, sum(spurious)::bigint as spurious_searches from calls"""


@query(BATTERY)
def battery_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Users as test calls; a low value stands for a search that nobody asked for."""
    issue = F.when(F.col("value") < 5, F.concat(F.lit("T1: RAG espurio: "), F.col("event_id").cast("string")))
    calls_ = table(spark, sf, "events").groupBy(F.col("user_id").alias("call_id")).agg((F.min("value") >= 1).alias("ok"), F.collect_list(issue).alias("issues"))
    return guards.battery(calls_)


@query("select event_id, greatest(0, least(200, trunc(value * 3 - 100)))::int as age, case when value * 1000 between 8000 and 192000 then trunc(value * 1000)::int else 48000 end as rate, left(event_type, 3) as kind from events")
def clamped_inputs(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", guards.whole_number(v * 3 - 100, 50).alias("age"), guards.sample_rate(v * 1000).alias("rate"), guards.short_text(F.col("event_type"), "none", 3).alias("kind"))


@query("select event_id from events where event_id % 5 = 0 or (value / 1000 >= 0.02 and value / 3 >= 12)")
def noise_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Values of events as loudness and share of voice; every fifth is too short to be measured."""
    rms = F.when(F.col("event_id") % 5 != 0, F.col("value") / 1000)
    return guards.voiced(table(spark, sf, "events").select("event_id", rms.alias("rms"), (F.col("value") / 3).alias("voice"))).select("event_id")


@query("select doc_id as case_id, level from (select doc_id, case toxic when 1 then 'rojo' else case quality when 1 then 'verde' else 'amarillo' end end as level, row_number() over (partition by toxic = 0 and quality = 1 order by doc_id) as n from labels where doc_id % 2 = 0 and doc_id % 3 > 0) where level <> 'verde' or n <= 7")
def evaluation_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as cases of two layers and two speakers; seven green ones are a report's own limit."""
    level = F.when(F.col("toxic") == 1, "rojo").when(F.col("quality") == 1, "verde").otherwise("amarillo")
    layer = F.when(F.col("doc_id") % 2 == 0, "clean").otherwise("noisy")
    speaker = F.when(F.col("doc_id") % 3 > 0, "paciente").otherwise("familiar")
    cases = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), level.alias("level"), layer.alias("layer"), speaker.alias("speaker"))
    return metrics.chosen_cases(cases, "clean", greens=7).select("case_id", "level")


POOLED = """
with v as (select vec_id, embedding::double[] as e, list_reverse(embedding::double[]) as r from embeddings where embedding is not null),
s as (select vec_id, case when vec_id % 2 = 1 then list_transform(list_zip(e, r), lambda x: x[1] + x[2]) else e end as t from v)
select vec_id, round(t[1] / sqrt(list_dot_product(t, t)), 6) as first, round(t[2] / sqrt(list_dot_product(t, t)), 6) as second from s"""


@query(POOLED)
def mean_pooling(spark: SparkSession, sf: str) -> DataFrame:
    """A vector and its reverse as the vectors of two tokens, of which the second counts every other time."""
    e = F.col("embedding")
    mean = retrieval.pooled(F.array(e, F.reverse(e)), F.array(F.lit(1), (F.col("vec_id") % 2).cast("int")))
    return table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", mean.alias("m")).select("vec_id", F.round(F.col("m")[0], 6).alias("first"), F.round(F.col("m")[1], 6).alias("second"))


@query("select user_id as call_id, count(*) as n, max(event_id) as last_source from events group by user_id")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the sources of calls, as records in order."""
    sources = table(spark, sf, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("n"), F.col("event_type").alias("doc_id"), F.col("event_type").alias("title"), F.lit("s").alias("section"), F.lit(1).alias("page_from"), F.lit(2).alias("page_to"))
    found = guards.cited(sources, F.lit("q"), F.lit(1))
    return found.select("call_id", F.size("cited").cast("long").alias("n"), F.element_at("cited", -1)["n"].alias("last_source"))


@query()
def font_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents; every ninth is set larger."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    size = F.when(F.pmod(F.col("doc_id") + F.col("pos"), F.lit(9)) == 0, 14.0).otherwise(10.0)
    return chunking.font_sections(lines.select("doc_id", (F.floor(F.col("pos") / 20) + 1).cast("int").alias("page"), "pos", "text", F.array(size).alias("sizes")))


GROUNDED = f"""
with want(k, pain, fever, wound, appetite, fever_felt, mentioned) as (values
  (0, 6.0, null, null, null, null, false), (1, null, null, null, null, null, false), (2, null, null, null, null, null, false), (3, null, null, null, 'nulo', null, false),
  (4, null, null, null, null, null, false), (5, null, null, null, null, true, false), (6, null, null, null, null, null, false))
select conv_id, turn, pain::double as pain, fever::double as fever, wound::varchar as wound, appetite, fever_felt::boolean as fever_felt, mentioned, null::varchar as sleep, null::boolean as pain_worse, null::boolean as bleeding,
  null::boolean as dyspnoea, null::boolean as vomiting, false as minimises from conversations join want on k = {K}"""


@query(GROUNDED)
def grounded_extraction(spark: SparkSession, sf: str) -> DataFrame:
    claims = {"pain": F.lit(9.0), "fever": F.lit(39.0), "wound": F.lit(None).cast("string"), "appetite": F.lit("nulo"), "sleep": F.lit("alterado"), **{n: F.lit(True) for n in rules.FLAGS}}
    return _answers(spark, sf).select("conv_id", "turn", *(c.alias(n) for n, c in grounding.grounded(claims, F.col("answer")).items()))


WS = r"[ \t\n\x0b\f\r]+"


@query()
def sentence_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn's text as a stream of its words; the same over parts in any order: speech_repair.sentences_as_they_come."""
    parts = F.split(F.coalesce("text", F.lit("")), "(?<= )")
    return table(spark, sf, "conversations").select("conv_id", "turn", speech_repair.sentence_stream(parts).alias("sentences"))


@query(rf"""
with p as (select conv_id, turn, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{WS}$', ''), '([.!?…]){WS}', '\1' || chr(1), 'g'), chr(1)) as s from conversations),
k as (select *, coalesce(list_min(list_filter(range(1, len(s)), lambda i: length(s[i]) < 25)), len(s)) - 1 as k from p),
o as (select conv_id, turn, list_append(s[1 : k], array_to_string(s[k + 1 :], ' ')) as o from k),
f as (select conv_id, turn, list_filter(list_transform(o, lambda x: regexp_replace(regexp_replace(x, '^{WS}', ''), '{WS}$', '')), lambda x: x <> '') as f from o)
select conv_id, turn, unnest(range(len(f))) as n, unnest(f) as sentence from f""")
def sentence_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of sentence_stream, a row each."""
    return sentence_stream(spark, sf).select("conv_id", "turn", F.posexplode("sentences").alias("n", "sentence"))


@query()
def similar_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every different word of the documents that is like a word of the domain."""
    words = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    targets = spark.createDataFrame([(t,) for t in speech_repair.TARGETS], "target string").select(T.fold(F.col("target")).alias("target"))
    return similar.similar(words, targets, 0.75).select("word", "target", F.round("ratio", 6).alias("ratio"))


@query()
def call_machine(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations as calls, a turn every seven seconds: what a call does at each answer, and its end."""
    said = table(spark, sf, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = said.withColumn("question", F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(before))
    answers = asked.where("role = 'user'").select(F.col("conv_id").alias("call_id"), F.col("turn").cast("int").alias("turn"), F.timestamp_seconds(F.col("turn") * 7).alias("ts"), "question", "text")
    return machine.replayed(answers).select("call_id", "turn", "action", "raised", "level", "call_level", "next_item", "unclear", "turns", "cause")


@query("""select conv_id, turn, 'El AGENTE preguntó: «' || left(coalesce(last_value(case when role = 'assistant' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), ''), 220) || '»' || chr(10) || 'El PACIENTE respondió (transcripción telefónica): «' || coalesce(text, '') || '»' as content
from conversations qualify role = 'user'""")
def extraction_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return records.extraction_inputs(table(spark, sf, "conversations"), "conv_id")


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return records.evaluated(rules.running_state(_symptoms(spark, sf)))


@query(f"""with {LEVEL}, lv as (select l.*, s.pain, s.fever, s.minimising from level l join state s using (call_id, turn))
select call_id, min(turn) as turn, 'rojo' as level, min_by({{'p': pain}}, turn).p as pain, round(min_by({{'f': fever}}, turn).f, 1) as fever from lv where level = 2 group by call_id""")
def alert_records(spark: SparkSession, sf: str) -> DataFrame:
    """The alert of each call; of its reasons and symptoms the SQL knows the numbers alone."""
    found = records.first_alerts(rules.running_state(_symptoms(spark, sf)), "pain", "fever")
    return found.where(F.size("reasons") > 0).select("call_id", "turn", "level", "pain", F.round("fever", 1).alias("fever"))


@query(f"""with {LEVEL}, lv as (select l.*, s.pain, s.fever, s.minimising from level l join state s using (call_id, turn))
select call_id, count(*) as turns, ['verde', 'amarillo', 'rojo'][max(level) + 1] as final_level, bool_or(level = 2) as alerted, min(turn) filter (where level = 2) as alert_turn,
  max_by({{'p': pain}}, turn).p as pain, round(max_by({{'f': fever}}, turn).f, 1) as fever, max_by(minimising, turn) as minimising from lv group by call_id""")
def call_summaries(spark: SparkSession, sf: str) -> DataFrame:
    found = records.summaries(_evaluated(spark, sf), "pain", "fever", "minimising")
    return found.select("call_id", "turns", "final_level", "alerted", "alert_turn", "pain", F.round("fever", 1).alias("fever"), "minimising")


@query("""with c as (select doc_id as caso_id, ['verde', 'amarillo', 'rojo'][quality + toxic + 1] as esperado, ['verde', 'amarillo', 'rojo'][n_chars % 3 + 1] as predicho from labels join documents using (doc_id)),
e as (select min(caso_id) as a, max(caso_id) as z from c)
select caso_id, case when caso_id = a then '[' else ' ' end || '{"caso_id":' || caso_id || ',"esperado":"' || esperado || '","predicho":"' || predicho || '"}' || case when caso_id = z then ']' else ',' end as line from c, e""")
def evaluation_array(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an evaluation's results as one JSON array (records.write_array writes them as a file)."""
    level = lambda c: F.element_at(F.array(*map(F.lit, rules.LEVELS)), c.cast("int") + 1)
    docs = table(spark, sf, "documents").select("doc_id", F.pmod("n_chars", F.lit(3)).alias("p"))
    cases = table(spark, sf, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("caso_id"), level(F.col("quality") + F.col("toxic")).alias("esperado"), level(F.col("p")).alias("predicho"))
    return records.array_lines(cases, "caso_id")


@query()
def block_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings repeated to a block of samples stand for recordings."""
    blocks = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("call_id"), F.col("vec_id").cast("int").alias("seq"), F.flatten(F.array_repeat("embedding", 16)).alias("samples"))
    return signal.quality(blocks)


GUARDS = f"""
with a as (select conv_id as call_id, turn, {K} as k from conversations),
d as (select *, bool_or(k = 0) over w as dolor, bool_or(k in (1, 5)) over w as fiebre, bool_or(k = 2) over w as herida, bool_or(k = 3) over w as apetito, count(*) filter (where k <> 6) over w as stretch
  from a window w as (partition by call_id order by turn rows unbounded preceding))
select call_id, turn * 2 + 1 as turn, ['dolor', 'fiebre', 'herida', 'apetito_sueno', 'confirmacion', 'fiebre', 'dolor'][k + 1] as slot, ['slot', 'slot', 'slot', 'slot', 'extract', 'slot', 'repeat'][k + 1] as action,
  null::varchar as alarm, false as alerted, case when not dolor then 'dolor' when not fiebre then 'fiebre' when not herida then 'herida' else 'movilidad' end as next_item,
  (case when k = 6 then count(*) filter (where k = 6) over (partition by call_id, stretch order by turn rows unbounded preceding) else 0 end)::int as unclear from d"""


@query(GUARDS)
def call_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Fixture questions and answers as the turns of the driver's conversations."""
    turns = _answers(spark, sf)
    said = turns.select(F.col("conv_id").alias("call_id"), (F.col("turn") * 2).alias("turn"), F.lit("assistant").alias("role"), F.col("question").alias("text"))
    return dialog.processed(said.unionByName(turns.select(F.col("conv_id").alias("call_id"), (F.col("turn") * 2 + 1).alias("turn"), F.lit("user").alias("role"), F.col("answer").alias("text"))))
