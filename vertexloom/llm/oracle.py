"""DuckDB SQL for the registered queries that SQL can express."""

from .quality_rules import FEATURES, MEASURES, SYMBOLS, WINDOW
from .queries import URL_RULES
from .url_filter import CANONICAL, HREF, REFRESH, TARGET

q = lambda s: "'" + s.replace("'", "''") + "'"

OP1 = """
with a as (select page_id, cast(floor(page_id / 512) as bigint) as file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as content, html from pages),
b as (select page_id, file, strlen(content) as length, sha256(content) as sha256, page_id % 97 = 13 and html[1:1] = '<' as bad from a)
select page_id, file, row_number() over w - 1 as pos, cast(sum(length) over w - length as bigint) as offset, length, sha256, case when bad then 'corrupt' else 'ok' end as status
from b window w as (partition by file order by page_id rows unbounded preceding)
"""

OP2 = r"""
with it as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
win as (select distinct item, least(8, len(w)) as k, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') as g from (select item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) as i from it where len(w) > 0)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
pos as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d cross join (select distinct k from win) where len(w) >= k)),
hit as (select doc_id, pos.k, i, item from pos join win using (k, g)),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join n using (doc_id) left join m using (doc_id)
"""

_esc = lambda c: rf"regexp_replace(regexp_replace(replace({c}, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"
OP5 = f"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(length('<|im_start|><|im_sep|><|im_end|>') + length({_esc('role')}) + length({_esc('text')})) as bigint) as formatted_chars
from r group by conv_id
"""

OP9 = f"""
with recursive rules(rule_host, rule_path, rule_verdict) as (values {", ".join(f"({q(h)}, {q(p)}, {q(v)})" for h, p, v in URL_RULES)}),
link as (select regexp_extract(url, '^[^#]*') as src, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) as base, unnest([
    regexp_extract(regexp_extract(html, {q(CANONICAL)}), {q(HREF)}, 1) || regexp_extract(regexp_extract(html, {q(CANONICAL)}), {q(HREF)}, 2) || regexp_extract(regexp_extract(html, {q(CANONICAL)}), {q(HREF)}, 3),
    regexp_extract(regexp_extract(html, {q(REFRESH)}), {q(TARGET)}, 1)]) as too from pages where url is not null and html is not null),
web as (select distinct regexp_extract(url, '^[^#]*') as src, regexp_extract(url, '^[^#]*')[strpos(url, '://') + 3:] as rest from pages where regexp_matches(url, '^[Hh][Tt][Tt][Pp][Ss]?://')),
plain as (select src, 'https://' || regexp_replace(translate(regexp_extract(rest, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as dst,
    array_to_string(list_filter(string_split(regexp_extract(rest, '(?s)^[^?]*[?](.*)', 1), '&'), lambda x: x <> '' and not starts_with(x, 'utm_')), '&') as query from web),
edge as (select src, case when too like '//%' then regexp_extract(base, '^[^:]*:') || too when too like '/%' then base || too else too end as dst from link where too <> ''
    union select src, dst || case when query <> '' then '?' || query else '' end from plain),
both_ as (select src, dst from edge where src <> dst union select dst, src from edge where src <> dst),
reach(node, other) as (select src, dst from both_ union select reach.node, both_.dst from reach join both_ on reach.other = both_.src),
comp as (select node, least(node, min(other)) as component from reach group by node),
urls as (select distinct url from pages union select node from comp),
part as (select url, case when strpos(url, '://') > 0 then url[strpos(url, '://') + 3:] else '' end as rest from urls),
split as (select url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from part),
fit as (select url, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(rule_verdict, length(rule_host || rule_path)) as rule_verdict
    from split join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by url),
cls as (select component, bool_or(rule_verdict = 'block') and not coalesce(bool_or(rule_verdict = 'allow'), false) as blocked from comp left join fit on comp.node = fit.url group by component)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(rule_verdict, case when blocked then 'block' end, 'allow') as verdict
from pages left join split using (url) left join fit using (url) left join comp on comp.node = regexp_extract(pages.url, '^[^#]*') left join cls using (component)
"""

_feat = {"len100": "100 * word_chars // n_words", "sym1000": "1000 * n_symbols // n_words", "dup1000": "1000 * n_dup_lines // n_lines", "rep1000": "1000 * n_repeat_words // n_words"}
_W = r"'[^\x20\x09-\x0D]+'"


_percents = sorted({x for p, _, _ in FEATURES.values() for x in (p, 100 - p, 50)})
_width = lambda v: f"(1::bigint << greatest(0, length(bin({v})) - 5))"


def _fences(name: str, keys: list[str]) -> str:
    k = ", ".join([*keys, "feature"])
    own = ", ".join(keys) + ", " if keys else ""
    return f"""{name}_m as (select {k}, bucket, sum(n) as n from sketch group by {k}, bucket),
{name}_c as (select *, sum(n) over (partition by {k} order by bucket) as upto, sum(n) over (partition by {k}) as docs from {name}_m),
{name}_q as (select {k}, max(docs) as docs, {", ".join(f"min(bucket) filter (upto * 100 >= docs * {x}) as q{x}" for x in _percents)} from {name}_c group by {k}),
{name} as (select {own}max(docs) as docs, """ + ", ".join(
        f"max(q{p} + {m} * greatest(q{p} - q50, {_width(f'q{p}')})) filter (feature = '{f}') as hi_{f}"
        + (f", max(q{100 - p} - {m} * greatest(q50 - q{100 - p}, {_width(f'q{100 - p}')})) filter (feature = '{f}') as lo_{f}" if both else "")
        for f, (p, m, both) in FEATURES.items()
    ) + f" from {name}_q" + (f" group by {', '.join(keys)}" if keys else "") + ")"


_names = [f"{p}_{f}" for f, (_, _, both) in FEATURES.items() for p in (("hi", "lo") if both else ("hi",))]
OP10 = rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_W}) as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_W})) as l from documents),
win as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d where len(w) >= {WINDOW})),
twice as (select doc_id, g from win group by doc_id, g having count(*) > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {WINDOW})) as p from win join twice using (doc_id, g)) group by doc_id),
m as (select doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[{SYMBOLS.decode()}]', '', 'g')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from d left join rep using (doc_id)),
f as (select *, {", ".join(f"case when n_words > 0 then {x} else 0 end as {k}" for k, x in _feat.items())} from m),
long as (select lang, source, unnest([{", ".join(q(k) for k in FEATURES)}]) as feature, unnest([{", ".join(FEATURES)}]) as v from f where not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)),
sketch as (select lang, source, feature, (v >> greatest(0, length(bin(v)) - 5)) << greatest(0, length(bin(v)) - 5) as bucket, count(*) as n from long group by all),
{_fences("o", ["lang", "source"])}, {_fences("l", ["lang"])}, {_fences("c", [])},
lim as (select o.lang, o.source, {", ".join(f"case when o.docs >= 50 then o.{n} when l.docs >= 50 then l.{n} else c.{n} end as {n}" for n in _names)} from o join l on o.lang is not distinct from l.lang cross join c),
j as (select f.*, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    {" or ".join(f"coalesce({k} > hi_{k}, false)" + (f" or coalesce({k} < lo_{k}, false)" if both else "") for k, (_, _, both) in FEATURES.items())} as over_
    from f left join lim on f.lang is not distinct from lim.lang and f.source is not distinct from lim.source)
select doc_id, {", ".join(x for x in MEASURES if x != "n_lines")}, base_failed, not base_failed and not over_ as kept from j
"""

ORACLE = {"op2_decontamination": OP2, "op1_warc_audit": OP1, "op5_chat_format": OP5, "op9_url_filter": OP9, "op10_quality_rules": OP10}
