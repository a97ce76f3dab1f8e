"""DuckDB's SQL for the rows of the queries that SQL can express on whole tables.

Not expressible, and held against plain versions or held-out labels in the tests: byte windows of strings
(op1), compression and trained classifiers (op4, op5), byte-pair tokens and packing (op6), near-duplicate
components over all pairs of texts (op7).
"""

from __future__ import annotations

from .url_filter import BLOCK_AT, RULES, TWO_LABEL_SUFFIXES, WEIGHTS, Z

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

EMBEDDINGS = """with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges as (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id, vec_id as c from embeddings union select e.v, r.c from reach r join edges e on e.u = r.vec_id),
low as (select vec_id, min(c) as component_id from reach group by 1),
links as (select u as vec_id, count(*) as n from edges group by 1)
select e.vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, component_id = e.vec_id as kept
from embeddings e join low using (vec_id) left join links using (vec_id)"""

CONTAMINATION = f"""with d as (select doc_id, regexp_extract_all({_LOWER}, {_WORD}) as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, {_WORD}) as w from benchmark),
win as (select distinct item_id, w[i:i + least(10, len(w)) - 1] as g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct len(g) as n from win),
dwin as (select doc_id, i, n, w[i:i + n - 1] as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, n, item_id from dwin join win using (g)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, item_id::varchar as x from hits) group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""

WORD_REPEATS = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
first as (select g, min(doc_id) as low from win group by 1 having count(*) > 1),
gone as (select distinct doc_id, p from (select win.doc_id, unnest(range(i, i + 50)) as p from win join first using (g) where low < win.doc_id)),
placed as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(x, ' ' order by p) as t from placed anti join gone using (doc_id, p) group by 1),
counted as (select doc_id, count(*) as n from gone group by 1)
select d.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id) left join counted using (doc_id)"""


def _rule_case(column: int) -> str:
    cases = []
    for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        cases.append(f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then '{(host + path, verdict)[column]}'")
    return f"case {' '.join(cases)} end"


def _mean(above: str = "above") -> str:
    return f"(k + w * {above}) / (n + w)"


def _weight(table: str) -> str:
    seen = "filter (where n > 0)"
    between = f"(sum(n * (k / n - above) * (k / n - above)) {seen} - sum(above * (1 - above)) {seen}) / nullif(sum(n) {seen}, 0)"
    typical = f"(sum(above * (1 - above)) {seen}) / nullif(count(*) {seen}, 0)"
    return f"(select greatest({WEIGHTS[0]}, least({WEIGHTS[1]}, coalesce(case when {between} > 0 then {typical} / ({between}) - 1 else {WEIGHTS[1]} end, {WEIGHTS[1]}))) as w from {table})"


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
URLS = rf"""with split as (select page_id, regexp_extract(rest, '^([^/?#]*)', 1) as h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from (select page_id, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from pages)),
p as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from split),
outcomes as (select doc_id as page_id, count(*) as n, sum(bad::int) as k from (select doc_id, quality = 0 or toxic = 1 as bad from labels) where bad is not null group by 1),
parts as (select host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''), '.') as l, n, k from p left join outcomes using (page_id)),
named as (select host, array_to_string(l[-2:], '.') in ({_TWO}) as two, l, n, k from parts),
hosts as (select host, case when two then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain, case when two then array_to_string(l[-2:], '.') else l[-1] end as suffix, coalesce(sum(n), 0) as n, coalesce(sum(k), 0) as k from named group by 1, 2, 3),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by 1, 2),
suffixes as (select suffix, sum(n) as n, sum(k) as k, (select (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) from domains) as above from domains group by 1),
s as (select suffix, {_mean()} as above from suffixes, {_weight('suffixes')}),
da as (select domain, n, k, above from domains join s using (suffix)),
dm as (select domain, {_mean()} as above from da, {_weight('da')}),
ha as (select host, n, k, above from hosts join dm using (domain)),
post as (select host, k + w * above as a, n - k + w * (1 - above) as b from ha, {_weight('ha')}),
rated as (select host, case when a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {BLOCK_AT} then 'block' else 'allow' end as v from post)
select page_id, host, path, {_rule_case(0)} as rule, coalesce({_rule_case(1)}, v) as verdict from p join rated using (host)"""

_CONTROL = r"'([\[<])(\\*/?(?:INST\]|SYS\]|TURN[ \]]|s>))'"
CHAT = rf"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as body, role as r, text as x from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, r nulls first, x nulls first) as p,
  length(regexp_replace(body, {_CONTROL}, '\1\\\2', 'g')) + case role when 'assistant' then 4 when 'user' then 15 else 13 end as size from t),
run as (select *, sum(size) over (partition by conv_id order by p) as so_far, max(p) over (partition by conv_id) as last from n)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' order by p)) as turns_sha256,
  cast(coalesce(sum(length(body)) filter (where role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(body, '' order by p) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' or p = last then so_far else 0 end) as bigint) as formatted_chars
from run group by 1"""

SQL = {
    "op2_embedding_near_dedup": EMBEDDINGS,
    "op3_benchmark_decontamination": CONTAMINATION,
    "op8_url_filters": URLS,
    "op9_substring_dedup": WORD_REPEATS,
    "op10_chat_formatting": CHAT,
}
