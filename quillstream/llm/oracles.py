"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quillstream.llm import tree_oracles

_OP1 = r"""
with w as (
  select doc_id, lang, source, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from w)),
covered as (
  select doc_id, count(distinct i + o) as n from windows, (values (0), (1), (2)) v(o) where c > 1 group by doc_id),
counts as (
  select doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, len(l)::bigint as n_lines,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from w left join covered c using (doc_id)),
good as (select * from counts where n_words >= 50 and 100 * n_repeat_words <= 50 * n_words),
ratios as (
  select lang, source, 'symbols' as ratio, 1000 * n_symbols // n_words as v from good
  union all select lang, source, 'dup_lines', 1000 * n_dup_lines // n_lines from good
  union all select lang, source, 'repeats', 1000 * n_repeat_words // n_words from good
  union all select lang, source, 'word_length', 1000 * word_chars // n_words from good
  union all select lang, source, 'words', n_words from good union all select lang, source, 'lines', n_lines from good),
buckets as (
  select lang, source, ratio, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) as b from ratios),
levels as (
  select lang, source, ratio, count(*) as n, quantile_disc(b, 0.03125) as q0, quantile_disc(b, 0.25) as q1, quantile_disc(b, 0.5) as q2, 0 as level from buckets group by all
  union all select lang, null, ratio, count(*), quantile_disc(b, 0.03125), quantile_disc(b, 0.25), quantile_disc(b, 0.5), 1 from buckets group by lang, ratio
  union all select null, null, ratio, count(*), quantile_disc(b, 0.03125), quantile_disc(b, 0.25), quantile_disc(b, 0.5), 2 from buckets group by ratio),
spreads as (
  select r.*, greatest(2 * (r.q2 - r.q1), r.q2 // 128, case r.ratio when 'word_length' then floor(2 * (r.q2 - r.q1) * sqrt(s.q2 / greatest(s.q0, 1))) else (case r.ratio when 'repeats' then 6000 else 1000 end) // greatest(s.q0, 1) end)::bigint as spread
  from levels r join levels s on s.level = r.level and s.lang is not distinct from r.lang and s.source is not distinct from r.source and s.ratio = case r.ratio when 'dup_lines' then 'lines' else 'words' end
  where r.ratio not in ('words', 'lines')),
fences as (
  select f.lang, f.source, f.ratio, c.q2 - 4 * c.spread as lo, c.q2 + 4 * c.spread as hi
  from spreads f join spreads g on g.level = 1 and f.ratio = g.ratio and f.lang is not distinct from g.lang join spreads e on e.level = 2 and e.ratio = f.ratio
  join spreads c on c.ratio = f.ratio and c.level = case when f.n >= 200 then 0 when g.n >= 200 then 1 else 2 end and (c.level = 2 or c.lang is not distinct from f.lang) and (c.level > 0 or c.source is not distinct from f.source)
  where f.level = 0 and e.n >= 200),
judged as (
  select c.*, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
    (select coalesce(bool_and(case f.ratio when 'symbols' then 1000 * n_symbols // n_words when 'dup_lines' then 1000 * n_dup_lines // n_lines
       when 'repeats' then 1000 * n_repeat_words // n_words else 1000 * word_chars // n_words end between f.lo and f.hi), true)
     from fences f where f.lang is not distinct from c.lang and f.source is not distinct from c.source) as inside
  from counts c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and inside as kept, n_lines from judged
"""

_UNITS = "minutes|seconds|degrees|percent|dollars|months|meters|metres|inches|hours|weeks|years|miles|euros|cents|days|feet|km/h|min|mph|mm|cm|km|kg|mg|lb|oz|ml|ms|m|g|l|s|h"
_OP10 = rf"""
with texts as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
names as (
  select kind, id, regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), '   '), '([\p{{Ll}}\p{{N}}][,;:]? )(\p{{Lu}})', '\1' || chr(2) || '\2', 'g') as t from texts),
numbers as (
  select kind, id, regexp_replace(regexp_replace(regexp_replace(lower(t), '([0-9])[.,]([0-9])', '\1\2', 'g'), '([0-9])[.,]([0-9])', '\1\2', 'g'), '(^|[^\p{{L}}\p{{N}}])([0-9])', '\1' || chr(1) || '\2', 'g') as t from names),
units as (
  select kind, id, regexp_replace(t, '(' || chr(1) || '[0-9]{{1,40}} )({_UNITS})([^\p{{L}}\p{{N}}]|$)', '\1' || chr(3) || '\2\3', 'g') as t from numbers),
words as (
  select kind, id, list_filter(string_split_regex(t, '[^\p{{L}}\p{{N}}\x01-\x03]+'), lambda x: x <> '') as w from units),
windows as (
  select kind, id, len(w) as n, i, w[i : i + 4] as raw, list_transform(w[i : i + 4], lambda x: case when ascii(x) < 4 then x[1] else x end) as k
  from (select kind, id, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5)),
items as (
  select id as item_id, n, i, raw, k from windows where kind = 'b' and len(list_filter(k, lambda x: ascii(x) > 3)) >= 3),
hits as (
  select d.id as doc_id, item_id, b.n, b.i as ipos, d.i - b.i as diagonal, b.raw as br, d.raw as dr
  from (select * from windows where kind = 'd') d join items b on d.k = b.k),
slots as (
  select doc_id, item_id, diagonal, br[j] as bv, dr[j] as dv from (select *, unnest(range(1, 6)) as j from hits) where ascii(br[j]) < 4),
bad as (
  select distinct doc_id, item_id, diagonal from (select doc_id, item_id, diagonal, bv from slots where ascii(bv) = 2 group by all having count(distinct dv) > 1)),
steady as (
  select * from hits h where not exists (select 1 from bad b where b.doc_id = h.doc_id and b.item_id = h.item_id and b.diagonal = h.diagonal)),
covered as (
  select doc_id, item_id, n, count(distinct ipos) as n_windows, count(distinct ipos + o) as words_covered
  from steady, (values (0), (1), (2), (3), (4)) v(o) group by all),
changed as (
  select doc_id, item_id, count(distinct (bv, dv)) as c from slots s where bv <> dv
   and not exists (select 1 from bad b where b.doc_id = s.doc_id and b.item_id = s.item_id and b.diagonal = s.diagonal) group by all)
select doc_id, item_id, n_windows::bigint as n_windows, words_covered::bigint as words_covered, n::bigint as item_words, coalesce(c, 0)::bigint as n_changed_slots
from covered left join changed using (doc_id, item_id) where words_covered >= 0.8 * n
"""

_OP3 = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 2)) as i from w where len(w) >= 4)
  union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 3),
n as (select doc_id, count(*) as n, string_agg(s, '|' order by s) as whole from s group by doc_id),
links as (
  select a.doc_id as u, b.doc_id as v from s a join s b on a.s = b.s and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by all having 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach as (select doc_id as u, doc_id as v from documents union select r.u, l.v from reach r join links l on l.u = r.v),
c as (select u, min(v) as c from reach group by u)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.c as component_id, d.doc_id = c.c as kept,
  case when n.n is null then d.doc_id else min(d.doc_id) over (partition by n.whole) end as class_id
from documents d left join n on n.doc_id = d.doc_id join c on c.u = d.doc_id
"""

_OP4 = """
with p as (select page_id, coalesce(html, '') as h from pages),
m as (select *, case when strlen(h) >= 1000 then max(page_id) over (partition by h) end as last from p)
select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest, case when last <> page_id then 'revisit' else 'response' end as record_type,
  case when last <> page_id then last end as refers_to, true as intact from m
"""

#: kind, what may stand before it, pattern with the value as its only group, least length of the value.
_SECRETS = (
    ("assign", "", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", "", "(AKIA[A-Z0-9]+)", 18),
    ("hex", "", "([0-9a-f]{16,})", 16),
    ("vendor", "(?:^|[^A-Za-z0-9])", "(gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{24,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{30,})", 20),
    ("jwt", "(?:^|[^A-Za-z0-9])", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 28),
    ("pem", "", r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,30}PRIVATE KEY-----)", 60),
    ("login", "", r"://[A-Za-z0-9._-]+:([A-Za-z0-9._~!$*+=-]+)@", 6),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FOUND = "\n  union all ".join(
    f"select doc_id, source, lang, {k} as k, '{name}' as kind, regexp_extract_all(t, {_quoted(before + pattern)}) as m, string_split_regex(t, {_quoted(before + pattern)}) as p, {_quoted('^' + before)} as before, {_quoted(before + pattern)} as pattern, {least} as least from d"
    for k, (name, before, pattern, least) in enumerate(_SECRETS)
)
_VALUES = "case kind " + " ".join(f"when '{name}' then regexp_extract(t, {_quoted(before + pattern)}, 1)" for name, before, pattern, _ in _SECRETS) + " end"
_BEFORE = "case kind " + " ".join(f"when '{name}' then length(regexp_extract(t, {_quoted('^' + before)}))" for name, before, _, _ in _SECRETS if before) + " else 0 end"
_OP6 = f"""
with d as (select doc_id, source, lang, coalesce(text, '') as t from documents),
f as ({_FOUND}),
e as (select doc_id, source, lang, k, kind, least, m[i] as t, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as pos
  from (select *, unnest(range(1, len(m) + 1)) as i from f)),
s as (select doc_id, source, lang, k, kind, (pos + {_BEFORE})::bigint as s, (pos + length(t))::bigint as e, {_VALUES} as value from e where length({_VALUES}) >= least),
o as (select value, count(distinct coalesce(source, '')) < 3 and count(distinct (coalesce(source, ''), coalesce(lang, ''))) < 6 as live from s group by value),
j as (select s.*, o.live, kind || ':' || s || ':' || e as span from s join o using (value)),
g as (select doc_id, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c, string_agg(span, ',' order by s, k) filter (k < 3) as base,
  string_agg(span, ',' order by s, k) filter (k < 3 or live) as spans, count(*) filter (live) as live, count(*) filter (not live) as example from j group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(live, 0) as n_live, coalesce(example, 0) as n_example from d left join g on g.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op1_quality_rules": _OP1, "op3_minhash_near_dedup": _OP3, "op4_warc": _OP4, "op6_secret_scans": _OP6, "op10_benchmark_decontamination": _OP10} | tree_oracles.ORACLES
