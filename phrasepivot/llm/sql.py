"""DuckDB SQL of the queries that SQL expresses."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.q::double[], b.q::double[])::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""with item as (select item_id::varchar as item, {_WORDS} as w from benchmark),
win as (select item, array_to_string(w[i:i + 12], ' ') as x, 13 as n from (select item, w, unnest(range(1, len(w) - 11)) as i from item where len(w) >= 13)
  union all select item, array_to_string(w, ' '), len(w) from item where len(w) between 1 and 12),
sizes as (select distinct n from win),
doc as (select doc_id, {_WORDS} as w from documents),
piece as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as x from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, sizes where len(w) >= n)),
met as (select doc_id, i, piece.n, item from piece join win on piece.x = win.x and piece.n = win.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from met) group by doc_id),
ids as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from met group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from doc left join hit using (doc_id) left join ids using (doc_id)"""

_RULES = "(values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) as r(action, rhost, rpath)"
_HOST = _LOWER.format("coalesce(regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's'), '')")
_PATH = "coalesce(regexp_extract({0}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
_BARE = "regexp_replace({0}, '#.*$', '', 's')"
_NODE = "case when contains({0}, '://') then " + _LOWER.format("split_part({0}, '://', 1)") + " || '://' || " + _HOST + " || regexp_extract({0}, '^.*?://[^/?#]*(.*)$', 1, 's') else {0} end"


def _node(url: str) -> str:
    return _NODE.replace("{0}", _BARE.replace("{0}", url))


def _ruled(source: str, key: str) -> str:
    return f"""select {key}, max_by(struct_pack(rule := rhost || rpath, action := action), len(rhost || rpath)) as best from {source}, {_RULES}
  where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by all"""


URLS = rf"""with recursive page as (select row_number() over () as row, page_id, url, {_node('url')} as node, {_HOST.replace('{0}', 'url')} as host, {_PATH.replace('{0}', 'url')} as path, html from pages),
tags as (select url, node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) as tag from page where url is not null),
found as (select url, node, case when regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') then regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
  when regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') then regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) end as target from tags),
asked as (select url, node, target, regexp_extract(target, '^[^?#]*', 0, 's') as own, regexp_extract(target, '^[^?#]*(\?[^#]*)', 1, 's') as query, case when {_PATH.replace('{0}', 'url')} = '' then '/' else {_PATH.replace('{0}', 'url')} end as base from found where target <> ''),
cut as (select *, string_split(case when own = '' then base when starts_with(own, '/') then own else regexp_extract(base, '^.*/', 0, 's') || own end, '/')[2:] as parts from asked),
closed as (select *, case when parts[-1] in ('.', '..') then list_append(parts, '') else parts end as closed_parts from cut),
kept as (select *, list_reduce(list_prepend([]::varchar[], list_transform(closed_parts, lambda x: [x])), lambda a, x: case when x[1] = '.' then a when x[1] = '..' then a[:greatest(len(a) - 1, 0)] else list_concat(a, x) end) as kept_parts from closed),
whole as (select node, case when contains(own, '://') then target when starts_with(target, '//') then split_part(url, '://', 1) || ':' || target
  when starts_with(target, '#') or regexp_matches(own, '^[A-Za-z][A-Za-z0-9+.\-]*:') then null
  else split_part(url, '://', 1) || '://' || {_HOST.replace('{0}', 'url')} || '/' || case when own = '' then base[2:] else array_to_string(kept_parts, '/') end || query end as target from kept),
edge as (select distinct node as a, {_node('target')} as b from whole where target is not null),
twoway as (select a, b from edge where a <> b union select b, a from edge where a <> b),
reach as (select a as node, a as member from twoway union select reach.node, twoway.b from reach join twoway on reach.member = twoway.a),
member as (select distinct member, {_HOST.replace('{0}', 'member')} as host, {_PATH.replace('{0}', 'member')} as path from reach),
said as ({_ruled('member', 'member')}),
alias as (select reach.node, case when bool_or(best.action = 'allow') then 'allow' when bool_or(best.action = 'block') then 'block' else 'allow' end as verdict from reach left join said on reach.member = said.member group by reach.node),
own as ({_ruled('page', 'row')})
select page_id, host, path, best.rule as rule, coalesce(best.action, alias.verdict, 'allow') as verdict from page left join own using (row) left join alias using (node)"""

_KEY = "trim(" + _LOWER.format("line") + ", e' \\t\\n\\v\\f\\r')"

LINES = f"""with doc as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (select row, doc_id, i, lines[i] as line from (select row, doc_id, lines, unnest(range(1, len(lines) + 1)) as i from doc)),
keyed as (select row, doc_id, i, line, {_KEY} as key from line),
repeated as (select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
judged as (select row, doc_id, i, line, first is not null and doc_id <> first as gone from keyed left join repeated using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from judged group by row, doc_id"""

PHRASES = f"""with doc as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from doc),
gram as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3), (4)) as ks(k) where len(w) >= k) group by all),
total as (select lang, sum(f)::bigint as n from gram where k = 1 group by lang),
cand as (select lang, k, phrase, string_split(phrase, ' ') as x, f as a from gram where k > 1 and f >= 30),
cut as (select lang, phrase, a, x, unnest(range(1, k)) as j from cand),
part as (select cut.lang, cut.phrase, cut.a, j, g.f as l, h.f as r, ((2000000::hugeint * cut.a) // (g.f + h.f))::bigint as score from cut
  join gram g on g.lang = cut.lang and g.phrase = array_to_string(x[:j], ' ') join gram h on h.lang = cut.lang and h.phrase = array_to_string(x[j + 1:], ' ')),
best as (select lang, phrase, a, arg_min(struct_pack(l := l, r := r, score := score), struct_pack(score := score, j := j)) as b from part group by all),
inside as (select lang, array_to_string(x[i:i + m - 1], ' ') as phrase, max(a) as most from (select lang, x, a, m, unnest(range(1, k - m + 2)) as i from cand, (values (2), (3)) as ms(m) where m < k) group by all),
kept as (select best.* from best left join inside using (lang, phrase) where most is null or 100 * most::hugeint < 80 * a::hugeint),
ranked as (select lang, row_number() over (partition by lang order by b.score desc, a desc, encode(phrase)) as rank, phrase, a, b.l as l, b.r as r, b.score as score from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000"""
