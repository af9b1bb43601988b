"""DuckDB SQL for the queries over words with places, written from the tables."""

from __future__ import annotations

_W = """w as (
  select o_orderkey as doc_id, i::int - 1 as pos, t[i] as text, c[i]::double as conf, x[i]::double as x0, y[i]::double as y0, (x[i] + wd[i])::double as x1, y[i]::double + 12 as y1,
    case when o_orderkey % 13 = 0 then 1 end as block, case when o_orderkey % 13 = 0 then ln[i] end as line
  from (select o_orderkey, unnest(range(1, 12)) as i,
    ['Acme', 'Works', 'GSTIN:', '27ABCDE1234F1Z5', 'Invoice No:', case when o_orderkey % 7 = 0 then '2024-01-05' else '~' end, case when o_orderkey % 4 = 3 then '27ABCDE1234F1Z5' else 'INV-' || o_orderkey end,
     'Grand Total', 'Tax', '₹' || case when o_orderkey % 11 = 0 then '0.00' else format('{:,.2f}', cast(o_totalprice as decimal(18,2))) end, '05/06/2024'] as t,
    [97, 95, 90, 88, 96, 20, 60 + o_orderkey % 40, 93, 80, 70 + o_orderkey % 30, 75] as c,
    [50, 105, 50, 120, 50, 135, case o_orderkey % 4 when 0 then 210 + o_orderkey % 5 * 60 when 1 then 50 + o_orderkey % 6 * 30 when 2 then 130 + o_orderkey % 3 * 90 else 210 end, 50, 200, 400 + o_orderkey % 3 * 100, 760] as x,
    [30, 31 + o_orderkey % 3, 60, 61, 100, 100, case o_orderkey % 4 when 0 then 101 when 1 then 112 + o_orderkey % 5 * 40 when 2 then 130 else 99 end, 300, 300, 302, 299] as y,
    [50, 55, 60, 140, 80, 60, 90, 90, 30, 120, 90] as wd, [1, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4] as ln from orders))"""


def _same(a: str, b: str, share: float = 0.5) -> str:
    low = f"least(greatest({a}.y1 - {a}.y0, 1), greatest({b}.y1 - {b}.y0, 1))"
    return f"(greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0) >= {low} * {share} or abs(({a}.y0 + greatest({a}.y1 - {a}.y0, 1) / 2) - ({b}.y0 + greatest({b}.y1 - {b}.y0, 1) / 2)) <= {low} * 0.6)"


def _line(a: str, b: str) -> str:
    return f"(coalesce({a}.block = {b}.block and {a}.line = {b}.line and {a}.line > 0, false) or {_same(a, b)})"


def _below(a: str, b: str) -> str:
    return f"({b}.y0 >= {a}.y0 + ({a}.y1 - {a}.y0) * 0.4 and {b}.y0 - {a}.y1 between -10 and 150 and (least({a}.x1, {b}.x1) > greatest({a}.x0, {b}.x0) or least(abs({b}.x0 - {a}.x0), abs({b}.x0 - {a}.x1)) <= 140))"


_DX = "case when v.x0 >= k.x0 then greatest(v.x0 - k.x1, 0) else k.x0 - v.x0 end"
_DY = "case when v.y0 >= k.y0 then greatest(v.y0 - k.y1, 0) else k.y0 - v.y0 end"
_DISTANCE = f"sqrt(({_DX}) * ({_DX}) + ({_DY}) * ({_DY}))"
_SPACE = "case when d < 40 then 1.0 when d < 120 then greatest(0.60, 1 - (d - 40) * 0.005) else greatest(0.10, 0.60 - (d - 120) * 0.002) end"
#: Half base, half space, to two places.
_CONTEXT = f"round((base::double + {_SPACE}) / 2, 2)"
_SCORE = "round(greatest(0::decimal(20,8), least(1::decimal(20,8), cast(kw as decimal(12,6)) * 0.30 + cast(pat as decimal(12,6)) * 0.25 + cast(conf / 100 as decimal(12,6)) * 0.20 + cast(posn as decimal(12,6)) * 0.15 + cast(ctx as decimal(12,6)) * 0.10 - minus)), 2)::double"

ORACLES: dict[str, str] = {
    "bare_word_lines": f"""
with recursive {_W},
p as (select doc_id, list(struct_pack(y0 := y0, x0 := x0, pos := pos, x1 := x1, y1 := y1, text := text, line := line) order by y0, x0, pos) as w from w group by doc_id),
f as (
  select doc_id, w, 0 as i, []::struct(y0 double, y1 double)[] as firsts, []::int[] as of_line from p
  union all
  select doc_id, w, i + 1, case when hit > 0 then firsts else list_append(firsts, struct_pack(y0 := n.y0, y1 := n.y1)) end, list_append(of_line, case when hit > 0 then hit else len(firsts) + 1 end::int)
  from (select *, w[i + 1] as n, coalesce(list_position(list_transform(firsts, lambda s: {_same("s", "w[i + 1]", 0.4)}), true), 0) as hit from f where i < len(w))),
e as (select doc_id, unnest(range(1, len(w) + 1)) as j, w, of_line from f where i = len(w)),
r as (select doc_id, case when doc_id % 13 = 0 then w[j].line else of_line[j] end as l, w[j] as x from e),
g as (select doc_id, l, string_agg(x.text, ' ' order by x.x0, x.pos) as text, count(*) as n_words, min(x.x0) as x0, min(x.y0) as y0, max(x.x1) as x1, max(x.y1) as y1,
  case when doc_id % 13 = 0 then min(x.y0) else arg_min(x.y0, x.x0 * 1000 + x.pos) end as top, min(x.y0 * 100000 + x.x0) as first from r group by doc_id, l)
select doc_id, row_number() over (partition by doc_id order by top, first) - 1 as line_no, text, n_words, x0, y0, x1, y1 from g""",
    "page_geometry": f"""
with {_W}
select k.doc_id, {_line("k", "v")} as same_line, (coalesce(k.line > 0 and v.line > 0 and abs(k.line - v.line) between 1 and 2, false) or greatest(case when v.y0 >= k.y1 then v.y0 - k.y1 else k.y0 - v.y1 end, 0) <= 80) as nearby,
  {_below("k", "v")} as below, round(case when a.x0 - t.x1 <= 400 then 0.80 - (a.x0 - t.x1 - 120) * 0.0007 else greatest(0.30, 0.60 - (a.x0 - t.x1 - 400) * 0.0005) end, 4) as nearness, v.y0 < 150 as top, round({_DISTANCE}, 6) as distance
from w k join w v using (doc_id) join w t using (doc_id) join w a using (doc_id) where k.pos = 4 and v.pos = 6 and t.pos = 7 and a.pos = 9""",
    "spatial_numbers": f"""
with {_W},
k as (select * from w where text = 'Invoice No:'),
v as (select * from w where text like 'INV-%' or text = '27ABCDE1234F1Z5'),
c as (
  select k.doc_id, 'right' as strategy, arg_min(v.pos, v.pos) as at from k join v using (doc_id) where v.pos between k.pos + 1 and k.pos + 7 and v.x0 > k.x0 and {_line("k", "v")} group by all
  union all
  select k.doc_id, 'below', arg_min(v.pos, v.pos) from k join v using (doc_id) where v.pos between k.pos + 1 and k.pos + 11 and {_below("k", "v")} group by all),
s as (select c.doc_id, strategy, v.text as value, v.conf, v.x0, v.y0, {_DISTANCE} as d, case strategy when 'right' then 1.0 else 0.8 end as base, v.text like '27%' as tax from c join k using (doc_id) join w v on v.doc_id = c.doc_id and v.pos = c.at),
t as (select *, 1.0 as kw, case when tax then 0.9 else 1.0 end as pat, 1.0 as posn, {_CONTEXT} as ctx, case when tax then 0.80 else 0 end as minus from s)
select doc_id, strategy, value, {_SCORE} as confidence, minus::double as penalty, case when tax then 'GSTIN' end as reason, x0, y0 from t""",
    "spatial_totals": f"""
with {_W},
k as (select * from w where text = 'Grand Total'),
v as (select *, case when pos = 9 then replace(text[2:], ',', '') else '5.00' end as value from w where pos = 10 or (pos = 9 and doc_id % 11 <> 0)),
c as (select k.doc_id, min(v.pos) as at from k join v using (doc_id) where v.pos > k.pos and v.x0 > k.x0 and {_line("k", "v")} group by k.doc_id),
s as (select c.doc_id, v.value, v.conf, v.x0, v.y0, {_DISTANCE} as d, 1.0 as base, 0 as minus from c join k using (doc_id) join v on v.doc_id = c.doc_id and v.pos = c.at),
t as (select *, 1.0 as kw, 1.0 as pat, 0.95 as posn, {_CONTEXT} as ctx from s)
select doc_id, value, {_SCORE} as confidence, x0, y0 from t""",
    "value_places": f"""
with {_W},
o as (select o_orderkey as doc_id, format('{{:,.2f}}', cast(o_totalprice as decimal(18,2))) as total from orders),
v as (select doc_id, 'vendor' as field, 'acme works' as value from o union all select doc_id, 'number', 'inv-' || doc_id from o union all select doc_id, 'total', total from o union all select doc_id, 'tax', 'gstin: 27abcde1234f1z5' from o union all select doc_id, 'none', 'zebra' from o),
m as (select v.doc_id, v.field, w.pos, w.x0, w.y0, w.x1, w.y1, w.conf from v join w on w.doc_id = v.doc_id and (contains(v.value, lower(w.text)) or contains(lower(w.text), v.value))),
r as (select a.doc_id, a.field, least(p.x0, q.x0) as x0, least(p.y0, q.y0) as y0, greatest(p.x1, q.x1) as x1, greatest(p.y1, q.y1) as y1, (p.conf + q.conf) / 2 as c
  from v a join w p on p.doc_id = a.doc_id and p.pos = case a.field when 'vendor' then 0 when 'tax' then 2 end join w q on q.doc_id = a.doc_id and q.pos = p.pos + 1
  union all select v.doc_id, v.field, w.x0, w.y0, w.x1, w.y1, w.conf from v join w on w.doc_id = v.doc_id and w.pos = 6 and lower(w.text) = v.value),
h as (select doc_id, field, arg_min(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, c := conf), pos) as b, avg(conf) as mean from m group by all)
select v.doc_id, v.field, case when r.c is not null then 'run' when h.b is not null then 'word' else 'none' end as how, coalesce(r.x0, h.b.x0) as x0, coalesce(r.y0, h.b.y0) as y0, coalesce(r.x1, h.b.x1) as x1, coalesce(r.y1, h.b.y1) as y1,
  round(coalesce(r.c, h.b.c)::decimal(20,6) / 100, 4)::double as run_confidence, round(h.mean::decimal(20,6) / 100, 4)::double as ocr_confidence
from v left join r using (doc_id, field) left join h using (doc_id, field)""",
    "exclusion_reasons": """
with s as (select o_orderkey as k, o_orderkey % 12 as f from orders),
r as (select k, case f when 1 then ['GSTIN'] when 2 then ['GSTIN', 'bare number'] when 4 then ['PAN'] when 5 then ['phone number', 'bare number']
  when 6 then ['phone number', 'bank account', 'bare number'] when 7 then ['IFSC code', 'HSN/SAC code'] when 8 then ['date'] when 9 then ['PIN code', 'bare number'] when 10 then ['tax percentage'] when 11 then ['HSN/SAC code', 'bare number'] else [] end as told from s)
select k as doc_id, array_to_string(told, '|') as reasons,
  coalesce(list_sum(list_transform(told, lambda x: case x when 'date' then 0.85 when 'tax percentage' then 0.85 when 'bank account' then 0.75 when 'PIN code' then 0.75 when 'HSN/SAC code' then 0.60 else 0.80 end)), 0)::double as penalty,
  case when len(told) > 0 then case when told[1] = 'PIN code' or told[1] = 'HSN/SAC code' then told[2] else told[1] end end as main_reason from r""",
}
