"""DuckDB SQL for the queries over mixed inputs, merged fields, named types and header lines."""

from __future__ import annotations

from quillstream.functions.seeds import ALIASES

_SEEDS = ", ".join(f"('{key}', '{alias}')" for key, alias, _, _ in ALIASES)
_ARRAY = "[" + ", ".join(f"'{alias}'" for _, alias, _, _ in ALIASES) + "]"


def _word(page: int, pos: int, text: str, conf: float = 100, box: str = "0, 0, 0, 0", line: int = 1) -> str:
    return f"select k as doc_id, {page} as page, {pos} as pos, {text} as text, {conf}::double as conf, {', '.join(f'{v}::double as {n}' for n, v in zip(('x0', 'y0', 'x1', 'y1'), box.split(', '), strict=True))}, 1 as block, 1 as paragraph, {line} as line, 1 as word_no from o where k % 7 = "


_WORDS = " union all ".join(
    sql + str(turn)
    for turn, sql in (
        (1, _word(1, 0, "'No'", 91.5, "10, 5, 30, 13")), (1, _word(1, 1, "k::varchar", 0, line=2)), (1, _word(1, 5, "'x'")), (2, _word(1, 0, "'w'", box="1, 2, 9, 6")), (3, _word(1, 0, "'b'", line=2)), (3, _word(1, 1, "'a'")), (3, _word(1, 2, "k::varchar")),
        (4, _word(2, 0, "'two'")), (4, _word(1, 0, "'own'")), (4, _word(1, 1, "'p2'", line=3)),
    )
)

ORACLES: dict[str, str] = {
    "mixed_words": f"with o as (select o_orderkey as k from orders) {_WORDS}",
    "mixed_texts": r"""
select k as doc_id, case when k % 10 = 0 then 'apart' else case k % 7 when 0 then 'Total for ' || k when 1 then 'No x' || chr(10) || k when 2 then 'given ' || k when 3 then 'a ' || k || chr(10) || 'b'
  when 4 then 'own' || chr(10) || 'p2' || chr(10) || 'two' when 5 then 'joined ' || k else '{"text": ' || k end end as text from (select o_orderkey as k from orders)""",
    "overlaid_fields": """
with o as (select o_orderkey as k, o_orderkey % 4 as t from orders),
f as (
  select k, 'vendor_name' as field, t in (0, 3) and k % 5 <> 0 as taken, 'own ' || k as own, 0.8 as own_conf, 'V' || k as inv, 'V' || k as norm, case when k % 7 = 0 then 0.8 else 0.9 end as conf from o
  union all select k, 'total_amount', t in (0, 3) or (t = 1 and k % 3 = 0), case when k % 3 <> 0 then '10' end, 0.6, '$' || k, k || '.00', 0.7 from o
  union all select k, 'store_name', t = 1 and k % 2 = 0 and k % 5 <> 0, case when k % 2 = 0 then '' else 'Shop' end, 0.95, 'V' || k, 'V' || k, 0.95 from o
  union all select k, 'memo', false, 'm', 0.5, null, null, null from o)
select k as doc_id, field, case when taken then inv else own end as value, case when taken then inv end as original_value, case when taken then norm end as normalized_value,
  case when taken then conf else own_conf end::double as confidence, case when taken then 'rule' else 'multi' end as source, taken from f""",
    "normalized_invoices": """
with o as (select o_orderkey as k, o_orderdate as d, cast(o_totalprice as decimal(18,2)) as a from orders),
n as (select k, case k % 7 when 0 then strftime(d, '%Y-%m-%d') when 1 then strftime(d, '%Y-%m-%d') end as day,
  case k % 7 when 3 then 'Date value is empty' when 4 then 'Date value contains no date digits or tokens' when 5 then 'Invalid calendar date: ''31/02/2024''' end as day_error,
  case when k % 5 in (0, 1) then a::double end as total,
  case k % 5 when 2 then 'Ambiguous or malformed negative format: ''--5''' when 3 then 'Invalid numeric amount: ''12,3'' does not conform to a valid numeric format' when 4 then 'Amount value is empty' end as total_error from o)
select k as doc_id, day_error is null and total_error is null as success, day as invoice_date, total as total_amount, concat_ws('; ', 'invoice_date: ' || day_error, 'total_amount: ' || total_error) as errors from n""",
    "hinted_types": """
select o_orderkey as doc_id, case o_orderkey % 7 when 2 then 'resume' when 3 then 'invoice' when 5 then 'receipt' when 6 then 'id_document' else lower(o_orderpriority) end as doc_type, case when o_orderkey % 7 in (2, 3, 5, 6) then 1.0 else 0.7 end::double as doc_confidence from orders""",
    "fallback_types": r"""
with d as (select doc_id, lower(concat_ws(chr(10), case doc_id % 6 when 0 then 'cv.pdf' when 1 then 'Tax Invoice 7.pdf' when 2 then 'scan.png' when 4 then 'certify that.txt' when 5 then 'receipT.docx' else '' end, coalesce(text, ''))) as t from documents),
r as (select doc_id, case when regexp_matches(t, 'resume|cv|curriculum vitae|work experience|skills|projects') then 1 when regexp_matches(t, 'invoice|bill to') then 2 when regexp_matches(t, 'receipt|subtotal|cashier') then 3
  when regexp_matches(t, 'bank statement|account balance|withdrawal') then 4 when regexp_matches(t, 'certificate|diploma|certify that') then 5 else 6 end as r from d)
select doc_id, ['Resume / CV', 'Commercial Invoice', 'Store / Retail Receipt', 'Bank Statement', 'Certificate', 'Unknown Document'][r] as doc_type, ['employment', 'financial', 'financial', 'financial', 'academic', 'general'][r] as family, case when r = 6 then 0.5 else 0.95 end::double as confidence from r""",
    "seeded_aliases": f"""
with own as (select 'custom.' || s_suppkey as canonical_key, case when s_suppkey <= 10 then {_ARRAY}[s_suppkey % {len(ALIASES)} + 1] else 'supplier_' || s_suppkey end as alias from supplier),
s as (select * from (values {_SEEDS}) v(canonical_key, alias))
select * from own union all select * from s where alias not in (select alias from own)""",
    "seeded_fields": """
with k as (select ['Commercial Invoice', 'Resume / CV', 'Certificate', 'Purchase Order'][o_orderkey % 4 + 1] as name, count(*) as documents from orders group by 1),
s as (select * from (values ('Commercial Invoice', 'financial', 6, 6), ('Resume / CV', 'own', 8, 3), ('Certificate', 'academic', 5, 2), ('Purchase Order', 'financial', 5, 4)) v(name, family, n_fields, n_canonical))
select name, family, documents, n_fields, n_canonical from k join s using (name)""",
    "vendor_candidates": """
with s as (select s_suppkey as k from supplier),
c as (
  select k, 0 as line_no, 'Acme ' || k || ' Ltd' as value, 1.0 as pat, 0.60 as ctx, case when k >= 1000 then 0.30 else 0 end as minus, true as company, false as address from s where k % 5 = 0
  union all select k, 1, 'Green Leaf', 0.85, 0.95, 0, false, true from s where k % 5 = 1
  union all select k, 1, 'plain words', 0.65, 0.95, 0, false, true from s where k % 5 = 2
  union all select k, 2, 'x', 0, 0, 0, false, true from s where false
  union all select k, 1, 'North Co 12345', 1.0, 0.60, 0.30, true, false from s where k % 5 = 3)
select k as doc_id, line_no, value, round(cast(0.075 + 0.25 * pat + 0.20 + 0.15 * (1 - 0.05 * line_no) + 0.10 * ctx - minus as decimal(18,8)), 2)::double as confidence, company, address from c""",
}
