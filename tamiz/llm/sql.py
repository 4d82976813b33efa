"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
with recursive usable as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(cast(embedding as double[]), cast(embedding as double[])) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reach(vec_id, y) as (select vec_id, vec_id from embeddings union select reach.vec_id, links.y from reach join links on reach.y = links.x),
degree as (select x as vec_id, count(*) as n from links group by x)
select vec_id, coalesce(n, 0) as n_links, min(y) as component_id, vec_id = min(y) as kept
from reach left join degree using (vec_id) group by vec_id, n
"""

OP4 = r"""
with words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
patterns as (
  select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as p
  from (select item_id, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)),
starts as (
  select doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') as p
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from words, (select distinct m from patterns))),
found as (select doc_id, starts.m, i, item_id from starts join patterns using (m, p)),
hit as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + m)) as pos from found) group by doc_id),
named as (
  select doc_id, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as id from found) group by doc_id)
select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (doc_id) left join named using (doc_id)
"""

OP10 = r"""
with split as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from split),
rules(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best as (
  select p.page_id, max_by(r.host || r.path, length(r.host || r.path)) as rule, max_by(r.verdict, length(r.host || r.path)) as verdict
  from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by p.page_id)
select page_id, host, path, rule,
  coalesce(verdict, case when regexp_matches(host || path, '(^|[.-])(casino|adult|spam|ads)[.-]') then 'block' else 'allow' end) as verdict
from parts left join best using (page_id)
"""

OP5 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as o from shingles a join shingles b using (s) where a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * o >= 75 * (p.n + q.n - o)),
reach(doc_id, y) as (select doc_id, doc_id from documents union select reach.doc_id, links.y from reach join links on reach.y = links.x)
select doc_id, coalesce(n, 0) as n_shingles, min(y) as component_id from reach left join sizes using (doc_id) group by doc_id, n
"""

OP6 = r"""
with words as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
starts as (
  select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as s
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
lowest as (select s, min(doc_id) as low from starts group by s having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as pos from starts join lowest using (s) where low < doc_id),
kept as (
  select u.doc_id, count(*) filter (where g.pos is not null) as n_removed, sha256(coalesce(string_agg(word, ' ' order by k) filter (where g.pos is null), '')) as kept_sha256
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from words) u left join gone g on g.doc_id = u.doc_id and g.pos = k group by u.doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256
from words left join kept using (doc_id)
"""

OP11 = r"""
with usable as materialized (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(cast(embedding as double[]), lambda x: floor(256 * x)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.r as a, a.vec_id as anchor_id, b.vec_id as vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from usable a join usable b on a.r <> b.r where a.vec_id % 100 = 0),
positives as (
  select a, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by a order by score desc, vec_id) as place
  from scores where same qualify place <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.a, place order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
from positives p join scores s on p.a = s.a and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""

OP12 = r"""
with docs as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
words as (
  select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
counts as (select lang, source, term, count(*) as n, count(distinct r) as d from words group by all),
kept as (select lang, term, sum(n)::hugeint as total from counts group by all having sum(d) >= 30),
sizes as (select lang, count(*)::hugeint as v, sum(total) as n from kept group by lang),
pairs as (select distinct lang, source from docs),
used as (select c.lang, c.source, c.term, c.n from counts c join kept using (lang, term)),
totals as (select lang, source, sum(n)::hugeint as n from used group by all),
p as (
  select g.lang, g.source, k.term, coalesce(u.n, 0) as n, 1 + (1000000000 * (coalesce(u.n, 0) + 5)::hugeint) // (coalesce(t.n, 0) + 5 * s.v) as p,
    1 + (1000000000 * (k.total + 5)) // (s.n + 5 * s.v) as q
  from pairs g join kept k using (lang) join sizes s using (lang) left join totals t using (lang, source) left join used u using (lang, source, term)),
apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from pairs a join pairs b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every qualify part = 'pair' or rank <= 50
"""

OP13 = r"""
with usable as materialized (
  select row_number() over () as r, vec_id, list_transform(cast(embedding as double[]), lambda x: floor(256 * x)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.r, a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.v, b.v) as bigint) as score
  from usable a join usable b on a.r <> b.r where a.vec_id % 50 = 0)
select query_id, row_number() over (partition by r order by score desc, vec_id) as rank, vec_id, score from scores qualify rank <= 5
"""

ORACLE: dict[str, str] = {"op1_near_vectors": OP1, "op4_decontaminate": OP4, "op5_jaccard_join": OP5, "op6_substring_dedup": OP6, "op10_url_filter": OP10, "op11_hard_negatives": OP11, "op12_source_divergence": OP12, "op13_exact_topk": OP13}
