"""SQL for the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

_REACHED = "reached(a, b) as (select a, b from both_ways union select r.a, l.b from reached r join both_ways l on l.a = r.b)"

VECTORS = f"""
with recursive
vectors as (select vec_id, min(embedding::double[]) as v from embeddings group by vec_id),
usable as (select * from vectors where vec_id is not null and list_sum(list_transform(v, lambda x: x * x)) > 0 and isfinite(list_sum(list_transform(v, lambda x: x * x))) and len(list_filter(v, lambda x: x is null)) = 0),
links as (select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id < b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95),
both_ways as (select a, b from links union all select b, a from links),
{_REACHED}
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, coalesce(least(vec_id, coalesce(low, vec_id)) = vec_id, false) as kept
from vectors left join (select a as vec_id, count(*) as n from both_ways group by 1) using (vec_id) left join (select a as vec_id, min(b) as low from reached group by 1) using (vec_id)
"""

REPEATS = r"""
with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) as h from (select doc_id, ws, unnest(generate_series(1, len(ws) - 49)) as s from split)),
lowest as (select h, min(doc_id) as low from windows group by h),
gone as (select distinct doc_id, unnest(generate_series(s, s + 49)) as i from windows join lowest using (h) where low < doc_id),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from split),
kept as (select w.doc_id, string_agg(word, ' ' order by w.i) as text, count(*) as n from words w left join gone g on g.doc_id = w.doc_id and g.i = w.i where g.i is null group by 1)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from split left join kept using (doc_id)
"""

JACCARD = rf"""
with recursive
split as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (select distinct doc_id, md5(array_to_string(ws[s:s + 2], ' ')) as h from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, least(len(ws), 1)))) as s from split)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
both_ways as (select a, b from links union all select b, a from links),
{_REACHED}
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id from split left join sizes using (doc_id) left join (select a as doc_id, min(b) as low from reached group by 1) using (doc_id)
"""
