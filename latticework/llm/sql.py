"""SQL of the queries that SQL can express. The others depend on fitted models, XXH64 or tokenizers, and
are tested against brute force, round trips or held-out accuracy instead."""

from __future__ import annotations

from latticework.llm import secrets, urlfilter

#: Words are what lies between white space; a window is named by its words.
OP5 = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, w, len(w) as n from d),
v as (select doc_id, s, array_to_string(list_slice(w, s + 1, s + 20), ' ') as t from (select doc_id, w, unnest(range(0, greatest(n - 19, 0))) as s from p)),
r as (select doc_id, s from (select doc_id, s, row_number() over (partition by t order by doc_id, s) as k from v) where k > 1),
g as (select distinct doc_id, unnest(range(s, s + 20)) as i from r),
k as (select p.doc_id, q.i, q.word from p, (select doc_id as id, unnest(range(0, n)) as i, unnest(w) as word from p) q where q.id = p.doc_id),
l as (select k.doc_id, string_agg(word, ' ' order by k.i) as kept, count(*) as m from k left join g on g.doc_id = k.doc_id and g.i = k.i where g.i is null group by 1)
select p.doc_id, cast(n as bigint) as n_words, cast(n - coalesce(m, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from p left join l using (doc_id)"""


def url_filter() -> str:
    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in urlfilter.RULES)
    hosts = " or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in urlfilter.BLOCKED_HOSTS)
    return rf"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1, 's') as path from pages),
r(h, q, rule, verdict) as (values {rules}),
m as (select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(r.verdict, length(rule)) as says from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by all)
select page_id, host, path, rule, coalesce(says, case when {hosts} then 'block' else 'allow' end) as verdict from m"""


OP8 = r"""
with d as (select doc_id, list_filter(string_split_regex(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, s + 1, s + least(10, len(w))), ' ') as t from (select item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) as s from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, s, array_to_string(list_slice(w, s + 1, s + n), ' ') as t from (select doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) as s from d, sizes)),
hits as (select doc_id, dw.n, s, item_id from dw join bw on bw.t = dw.t and bw.n = dw.n),
words as (select doc_id, count(*) as c from (select distinct doc_id, unnest(range(s, s + n)) as i from hits) group by 1),
items as (select doc_id, count(*) as c, string_agg(i, ',' order by i) as l from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(words.c, 0) as bigint) as n_hit, cast(coalesce(items.c, 0) as bigint) as n_items,
    sha256(coalesce(items.l, '')) as items_sha256, coalesce(words.c, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""


def secret_scan() -> str:
    """Matches and the pieces between them alternate, so running sums of their lengths are the places."""
    found = []
    for order, (kind, pattern, group, least) in enumerate((*secrets.BASE, *secrets.RULES)):
        p = "'" + pattern.replace("}+", "}").replace("'", "''") + "'"
        found.append(f"select r, {order} as o, '{kind}' as kind, {least} as least, regexp_extract_all(t, {p}, 0) as w, regexp_extract_all(t, {p}, {group}) as j, string_split_regex(t, {p}) as g from d")
    numbers = ", ".join(f"coalesce({k}, 0) as n_{k}" for k, *_ in secrets.BASE)
    counts = ", ".join(f"count(*) filter (kind = '{k}') as {k}" for k, *_ in secrets.BASE)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(found)}),
x as (select r, o, kind, least, unnest(w) as w, unnest(j) as j, unnest(g[1:len(w)]) as g, unnest(range(len(w))) as i from m where len(w) > 0),
p as (select r, o, kind, least, length(j) as n, length(w) as size, sum(length(g) + length(w)) over (partition by r, o order by i) as z from x),
s as (select r, o, kind, cast(z - size as bigint) as a, cast(z as bigint) as z from p where n >= least),
b as (select r, {counts}, string_agg(kind || ':' || a || ':' || z, ',' order by a, o) as base from s where o < {len(secrets.BASE)} group by r),
free as (select * from s where o >= {len(secrets.BASE)} and not exists (select 1 from s q where q.r = s.r and q.o < {len(secrets.BASE)} and s.a < q.z and q.a < s.z)),
chosen as (select r, list_reduce(list([{{'kind': kind, 'o': o, 'a': a, 'z': z}}] order by a, o), lambda done, y: if(y[1].a >= done[-1].z, done || y, done)) as l from free group by r),
every as (select r, kind, o, a, z from s where o < {len(secrets.BASE)} union all select r, y.kind, y.o, y.a, y.z from (select r, unnest(l) as y from chosen)),
e as (select r, string_agg(kind || ':' || a || ':' || z, ',' order by a, o) as spans from every group by r)
select doc_id, {numbers}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join b using (r) left join e using (r)"""


ORACLES: dict[str, str] = {"op5_substring": OP5, "op6_urlfilter": url_filter(), "op8_decontamination": OP8, "op9_secrets": secret_scan()}
