"""SQL of queries that compare all rows with each other: for checks on small tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_SETS = rf"""texts as (select id, any_value(hl) hl, any_value(body) body, bool_or(split_name = 'train') tr, bool_or(split_name in ('test', 'validation')) ev from articles where id is not null group by id),
listed as (select id, list_concat({_WORDS.format('hl')}, {_WORDS.format('body')}) w from texts),
shingle as (select distinct id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] s from (select id, w, unnest(range(1, len(w) - 1)) i from listed where len(w) >= 20)),
sized as (select id, count(*) n from shingle group by id),
common as (select a.id id_a, b.id id_b, count(*) c from shingle a join shingle b on a.s = b.s and a.id < b.id group by all),
near as (select id_a, id_b from common join sized a on a.id = id_a join sized b on b.id = id_b where c >= 0.6 * (a.n + b.n - c))"""
_HAS = "case when lower(trim({0})) not in ('none', '') then {0} end"
_KEY = f"coalesce({', '.join(_HAS.format(c) for c in ('fb', 'wd', 'db'))}, phrase)"

_SPANS = """starts as (select doc_id, k, hash(substr(text, k, 300)) h from (select doc_id, text, unnest(range(1, length(text) - 298)) k from documents where length(text) >= 300)),
held as (select h from starts group by h having count(distinct doc_id) > 1), shared as (select distinct doc_id, k from starts where h in (select h from held)),
marked as (select *, k > lag(k) over (partition by doc_id order by k) + 300 new from shared), runs as (select *, sum(coalesce(new, true)::int) over (partition by doc_id order by k) g from marked),
spans as (select doc_id, min(k) - 1 span_start, max(k) + 299 span_end from runs group by doc_id, g)"""

ORACLES = {
    "p2_found": f"""with rows as (select 'features' field_name, id k, features v from neural_models union all select 'w2v', {_KEY}, w2v from annotations),
held as (select field_name, k, max(v)::double[64] v from rows where k is not null and len(v) = 64 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0 group by all),
pair as (select a.field_name, a.k a, b.k b, round(array_cosine_similarity(a.v, b.v), 10) c from held a join held b on a.field_name = b.field_name and a.k <> b.k),
best as (select * from (select *, row_number() over (partition by field_name, a order by c desc, b) r from pair) where r <= 5 and c >= 0.85)
select distinct field_name, least(a, b) key_a, greatest(a, b) key_b from best""",
    "p3_found": f"with {_SETS} select id_a, id_b from near",
    "p5_found": f"with {_SETS} select id_a, id_b from near join texts a on a.id = id_a join texts b on b.id = id_b where (a.tr and b.ev) or (a.ev and b.tr) union all select id, id from texts where tr and ev",
    "p9_found": rf"""with w as (select doc_id, {_WORDS.format('text')} w from documents), i as (select item_id, {_WORDS.format('text')} w from eval_items),
runs as (select doc_id, w[k:k + 11] r from (select doc_id, w, unnest(range(1, len(w) - 10)) k from w where len(w) >= 12)),
items as (select item_id, w[k:k + 11] r from (select item_id, w, unnest(range(1, len(w) - 10)) k from i where len(w) >= 12))
select distinct doc_id, item_id from runs join items using (r)""",
    "p3_groups": f"""with recursive {_SETS}, pair as (select id_a a, id_b b from near union all select id_b, id_a from near),
sim as (select p.a, p.b, x.n = y.n and c = x.n same, c / (x.n + y.n - c) s from pair p join common on id_a = least(a, b) and id_b = greatest(a, b) join sized x on x.id = a join sized y on y.id = b),
class as (select id, least(id, coalesce(min(b) filter (where same), id)) class_id, count(b) filter (where same) + 1 class_size, max(s) best from sized left join sim on a = id group by id),
links as (select x.id, count(distinct y.class_id) links from class x join pair on a = x.id join class y on y.id = b where x.class_id <> y.class_id group by x.id),
reach as (select a id, a other from pair union select r.id, b from reach r join pair on a = r.other), part as (select id, min(other) group_id from reach group by id)
select id, group_id, class_id, class_size, coalesce(links, 0) links, round(case when class_size > 1 then 1.0 else best end, 6) similarity from class join part using (id) left join links using (id)""",
    "p5_report": f"""with {_SETS}, pair as (select id_a e, id_b t from near union all select id_b, id_a from near),
hit as (select e id from pair join texts a on a.id = e join texts b on b.id = t where a.ev and b.tr union all select id from texts where tr and ev), n as (select id, count(*) pairs from hit group by 1),
own as (select distinct id, lower(trim(split_name)) split_name, source from articles where id is not null and lower(trim(split_name)) in ('test', 'validation'))
select split_name, source, count(*) articles, count(pairs) overlapping, coalesce(sum(pairs), 0)::bigint pairs from own left join n using (id) group by all""",
    "p9_items": rf"""with w as (select doc_id, {_WORDS.format('text')} w from documents), i as (select item_id, {_WORDS.format('text')} w from eval_items),
runs as (select doc_id, k, w[k:k + 11] r from (select doc_id, w, unnest(range(1, len(w) - 10)) k from w where len(w) >= 12)),
items as (select item_id, j, w[j:j + 11] r from (select item_id, w, unnest(range(1, len(w) - 10)) j from i where len(w) >= 12)),
met as (select distinct doc_id, item_id, k, j from runs join items using (r)), lined as (select *, k - row_number() over (partition by doc_id, item_id, k - j order by k) g from met),
long as (select doc_id, item_id, k - j d, g, count(*) + 11 n from lined group by all)
select item_id, count(distinct doc_id) n_docs, max(n)::int run_words from long group by 1""",
    "p10_found": f"with {_SPANS} select * from spans",
    "p10_share": f"""with {_SPANS}, n as (select doc_id, sum(span_end - span_start)::bigint shared_chars from spans group by 1)
select doc_id, length(text) n_chars, coalesce(shared_chars, 0) shared_chars, round(case when length(text) > 0 then coalesce(shared_chars, 0) / length(text) end, 6) share from documents left join n using (doc_id)""",
}
