"""DuckDB SQL for the queries over answers and documents under review, written against the tables."""

from __future__ import annotations

_L = "(select l_orderkey as k, l_linenumber as n, l_quantity::int as q, round((1 - l_discount) * 100)::int as h from lineitem)"
_HALF_UP = "((2 * {s} + {n}) // (2 * {n}) / 100.0)::double"

ORACLES: dict[str, str] = {
    "answer_values": """
select o_orderkey as doc_id, 'vendor_name' as field, case o_orderkey % 3 when 0 then 'V {' || o_orderkey || '}' when 1 then 'V' || o_orderkey end as value, case o_orderkey % 3 when 0 then 0.9 when 1 then 0.7 else 0 end::double as confidence from orders
union all select o_orderkey, 'total_amount', case when o_orderkey % 3 = 1 then '12.75' end, case when o_orderkey % 3 = 1 then 0.85 else 0 end::double from orders
union all select o_orderkey, 'extra', '5', 0.8::double from orders where o_orderkey % 3 = 0""",
    "merged_values": """
with o as (select o_orderkey as k, o_orderkey % 3 as m from orders)
select k as doc_id, 'store_name' as field, 'S' || k as value, 'S' || k as normalized_value, 0.85::double as confidence, 'rule+ai' as source from o where m = 0
union all select k, 'vendor_name', 'S' || k, 'S' || k, 0.8, 'ai' from o where m = 0
union all select k, 'candidate_name', 'P' || k, 'P' || k, 0.9, 'ai' from o where m = 1
union all select k, 'person_name', 'P' || k, 'P' || k, 0.9, 'ai' from o where m = 1
union all select k, 'full_name', 'Q' || k, 'Q' || k, 0.5, 'ai' from o where m = 1
union all select k, 'account_holder', case when k % 2 = 1 then 'H' else 'C' end || k, case when k % 2 = 1 then 'H' else 'C' end || k, 0.7, 'ai' from o where m = 2
union all select k, 'customer_name', 'C' || k, 'C' || k, 0.7, 'ai' from o where m = 2 and k % 2 = 0
union all select k, 'balance_amount', '1,234.50', '1234.50', 0.85, 'rule' from o where m = 2
union all select k, 'statement_date', '03/04/2024', '2024-04-03', 0.5, 'rule' from o where m = 2""",
    "asked_fields": """
with o as (select o_orderkey as k, o_orderkey % 3 as m from orders)
select k as doc_id, 'vendor_name' as key, case m when 0 then 'V' || k when 1 then 'exact ' || k end as value, case m when 0 then 'V' || k when 1 then 'exact ' || k else '' end as quote,
  case when m < 2 then 'model' else 'none' end as found, case when m = 2 then 0.95 end::double as confidence, case when m = 2 then 'verified' end as status from o
union all select k, 'items', case when k % 2 = 0 then 'a, b' else 'n: x' || chr(10) || 'n: y | p: 2' end, case when k % 2 = 0 then 'a, b' else 'n: x' end, 'model', null, null from o
union all select k, 'ship_to', case when k % 5 = 0 then 'F' || k end, case when k % 5 = 0 then 'quoted' else '' end, case when k % 5 = 0 then 'rule' else 'none' end, case when k % 5 <> 0 then 0.95 end, case when k % 5 <> 0 then 'verified' end from o""",
    "discovered_fields": """
select o_orderkey as doc_id, x.key as key, x.label as label, coalesce(x.value, 'v' || o_orderkey) as value, 'Additional Information' as section, 'string' as data_type
from (select o_orderkey, unnest([{'key': 'ship_via', 'label': 'Ship Via', 'value': 'air'}, {'key': 'other_one', 'label': 'Other One', 'value': null}, {'key': 'again_2', 'label': 'Again', 'value': 'z'}]) as x from orders)""",
    "answer_tables": """
select o_orderkey as doc_id, t as key, case when o_orderkey % 2 = 0 then 'a' else 'c1|c2' end as headers,
  case when o_orderkey % 2 = 0 then o_orderkey || ';2' when t = 't1' and o_orderkey % 3 = 0 then 'r' || o_orderkey || '|;|x' else '' end as rows,
  case when o_orderkey % 2 = 0 then 0.9 when t = 't1' and o_orderkey % 3 = 0 then 0.95 else 0.8 end::double as confidence
from (select o_orderkey, unnest(['t1', 't2']) as t from orders)""",
    "typed_route": f"""
with g as (select k, count(*) as n, sum(case when q % 25 = 0 then 0 else h end)::bigint as s, list('Line ' || n order by n) filter (q % 25 = 0 or q % 26 = 0) as gone from {_L} group by k),
c as (select k, gone, {_HALF_UP.format(s='s', n='n')} as c from g)
select k as doc_id, c as confidence, case when c >= 0.85 and gone is null then 'VERIFIED' else 'NEEDS_REVIEW' end as status,
  case when gone is not null then 'Fields missing or requiring review: ' || array_to_string(gone[1:3], ', ') when c < 0.85 then 'Document confidence below verification threshold' end as reason from c""",
    "evaluated_documents": f"""
with g as (select k, count(*) as n, sum(h)::bigint as s, count(*) filter (q % 30 = 0) as loose, list('line_' || n order by n) filter (q % 20 = 0) as failing from {_L} where q > 3 group by k),
r as (select o_orderkey as k, n, s, case when n is null then 'No fields extracted from document.' else concat_ws('; ', case when loose > 0 then loose || ' field(s) ungrounded in document text' end,
  case when failing is not null then 'Fields requiring human review: ' || array_to_string(failing[1:4], ', ') end, case when o_orderkey % 7 = 0 then 'sum differs' end) end as reasons from orders left join g on g.k = o_orderkey)
select k as doc_id, coalesce({_HALF_UP.format(s='s', n='n')}, 0)::double as confidence, case when reasons = '' and s >= 85 * n then 'VERIFIED' else 'NEEDS_REVIEW' end as status, reasons from r""",
    "overall_after_edits": f"""
select k as doc_id, case when count(*) filter (q % 3 <> 0) = 0 then 1 else (2 * 100 * sum(h) filter (q % 3 <> 0) + count(*) filter (q % 3 <> 0))::bigint // (2 * count(*) filter (q % 3 <> 0)) / 10000.0 end::double as confidence from {_L} group by k""",
    "revalidated": """
with o as (select o_orderkey as k, o_orderkey % 4 = 0 or o_orderkey % 2 = 0 as inv from orders),
e as (select k, concat_ws('; ', case when k % 5 = 0 then 'bad name' end, case when inv and k % 3 = 0 then 'Vendor Name is required' end, case when inv then 'Total Amount must be greater than 0' end,
  case when not inv and k % 3 = 0 then 'vendor_name is required and cannot be empty' end, case when not inv and k % 3 = 1 then 'note is required and cannot be empty' end) as errors from o)
select k as doc_id, errors = '' as is_valid, errors from e""",
    "rule_failures": "select l_orderkey as doc_id, 'a.b.line_' || l_linenumber as key, case l_linenumber when 1 then 1 when 2 then 2 else 0 end::bigint as n_failures from lineitem",
    "looked_up_fields": """
select o_orderkey as doc_id, 'grand_total' as name, case when o_orderkey % 3 = 0 then 'grand_total' when o_orderkey % 2 = 0 then 'inv.grand_total' else 'b.grand_total' end as key,
  case when o_orderkey % 3 = 0 then 'key ' when o_orderkey % 2 = 0 then 'end ' else 'late ' end || o_orderkey as value from orders""",
    "extraction_by_source": """
with x as (select o_orderkey as k, case when o_orderkey % 2 = 0 then 't' || o_orderkey when o_orderkey % 5 in (0, 1) then 'T' || o_orderkey end as r, case when o_orderkey % 3 = 0 then 'other' when o_orderkey % 5 in (0, 2) then 'T' || o_orderkey end as m from orders)
select k as doc_id, 'total' as field, r as rule_value, m as model_value, case when k % 5 = 0 or lower(r) = lower(m) then 'AGREED' when r is not null and m is not null then 'REVIEW REQUIRED' when r is not null or m is not null then 'SINGLE_SOURCE' else 'MISSING' end as outcome from x""",
    "full_text": "select l_orderkey as doc_id, string_agg('line_' || l_linenumber, chr(10) || chr(10) order by l_linenumber % 2, l_linenumber) as text from lineitem where l_linenumber % 3 <> 0 group by 1",
    "block_kinds": r"""
with b as (select unnest(string_split(text, chr(10))) as t from documents)
select case when length(t) < 80 and t = upper(t) and lower(t) <> upper(t) and not regexp_matches(t, '\p{Ll}') and regexp_matches(t, '\p{Lu}') then 'heading'
  when length(t) < 80 and regexp_matches(t, '\p{Lu}') and len(list_filter(regexp_extract_all(t, '\p{L}+'), lambda w: not regexp_full_match(w, '\p{Lu}[^\p{Lu}]*') and not regexp_full_match(w, '[^\p{Lu}\p{Ll}]+'))) = 0 then 'heading'
  when regexp_matches(t, '^\s*([•●▪◦*-]|[0-9]+[.)])\s') then 'list' else 'paragraph' end as kind, count(*) as n from b group by 1""",
    "occurrence_boost": f"select k as doc_id, n as pos, (least(100, h + case when count(*) over (partition by k, q % 4) > 1 then 5 else 0 end) / 100.0)::double as confidence from {_L}",
    "keyword_proximity": f"""
select k as doc_id, n as pos, (case when n > 4 then greatest(1000, 7000 - 2000 * (n - 4)) when n % 4 = 0 then case when q % 9 = 0 or q <= 4 then 10000 when q <= 20 then greatest(7500, 10000 - (q - 4) * 150) else greatest(4000, 7500 - (q - 20) * 100) end
  when n % 4 = 1 then 8000 else greatest(1000, 8000 - 2500 * (n % 4 - 1)) end + 50)::bigint // 100 / 100.0 as proximity from {_L}""",
    "plausible_dates": "select o_orderkey as doc_id, o_orderkey % 5 in (0, 3) or (o_orderkey % 5 = 2 and year(o_orderdate) % 100 <= 40) as plausible from orders",
    "passes_outcome": f"""
with x as (select *, case when q % 7 = 0 then 0.4 when q % 4 = 0 then 0 when q % 4 = 3 then 0.6 when q % 4 = 2 then 0.95 else 0.9 end::double as c from {_L})
select k as doc_id, 'line_' || n as field, c as confidence, case when c >= 0.9 then 'verified' else 'needs_review' end as status from x""",
    "replaced_run": "select l_orderkey as run_id, 'line_' || l_linenumber as field, 'old' as value from lineitem where l_orderkey % 3 <> 0 union all select o_orderkey, 'total', 'new' from orders where o_orderkey % 3 = 0",
    "verified_runs": "select user_id as document_id, event_id as run_id, case when user_id % 2 = 0 and row_number() over (partition by user_id order by ts desc, event_id desc) = 1 then 'VERIFIED' else 'NEEDS_REVIEW' end as status from events where user_id is not null",
    "reprocessed_runs": """
select o_orderkey as document_id, case when o_orderkey % 5 = 0 then 'PROCESSING' when o_orderkey % 2 = 0 then 'VERIFIED' else 'FAILED' end as status, case when o_orderkey % 5 = 0 then 'QUEUED' end as run_status,
  case when o_orderkey % 5 = 0 then case when o_orderkey % 2 = 0 then 'VERIFIED' else 'FAILED' end end as reprocessed_from from orders""",
    "text_metrics": r"""
with p as (select doc_id, unnest(string_split(text, chr(10))) as t from documents), a as (select doc_id, t, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) as a from p)
select doc_id, sum(length(t))::bigint as n_chars, sum(len(regexp_extract_all(t, '[^\s]+')))::bigint as n_words, sum(a)::bigint as n_alnum, count(*) filter (a >= 10) as pages_with_text, count(*) as n_pages, (sum(a) < 25 or count(*) filter (a >= 10) = 0) as likely_scanned from a group by 1""",
    "normalize_by_name": """
select o_orderkey as doc_id, 'Birth_Day' as field, strftime(o_orderdate, '%Y-%m-%d') as value, true as valid from orders union all select o_orderkey, 'salary', cast(cast(o_totalprice as decimal(18,2)) as varchar), true from orders
union all select o_orderkey, 'fee', 'free', false from orders union all select o_orderkey, 'name', 'Jo', true from orders""",
    "typed_values": """
select o_orderkey as doc_id, 'Bool' as kind, case when o_orderkey % 2 = 0 then 'true' end as value, o_orderkey % 2 = 0 as valid from orders union all select o_orderkey, 'id', 'A' || o_orderkey, true from orders
union all select o_orderkey, 'date', strftime(o_orderdate, '%Y-%m-%d'), true from orders where day(o_orderdate) > 12 union all select o_orderkey, 'email', 'nobody', false from orders union all select o_orderkey, 'money', null, true from orders""",
    "mean_confidence": "select round(avg(cast((o_orderkey % 101) / 100.0 as decimal(6,2))), 3)::double as mean_confidence from orders where o_orderkey % 11 <> 0",
    "list_of_type": "select o_orderkey as document_id, o_orderpriority as file_type from orders where o_orderpriority = '1-URGENT' and o_orderkey % 13 <> 0 order by o_orderdate desc, o_orderkey desc limit 25",
    "field_sections": f"""
with s as (select k, case q % 3 when 0 then 'Totals' when 1 then 'General' else 'Lines' end as section, min(n) as f, count(*) as c from {_L} group by all)
select k as doc_id, section, c as n, row_number() over (partition by k order by f, section)::integer as place from s""",
    "rule_outcome_counts": f"select k as doc_id, count(*) filter (q % 3 = 2) as passed, count(*) filter (q % 3 = 0) as failed from {_L} group by k",
    "primary_sources": f"select k as doc_id, 'source ' || m as source from (select k, q % 3 as m, count(*) as c from {_L} group by all) qualify row_number() over (partition by k order by c desc, m) = 1",
    "evidence_boxes": f"select k as doc_id, min(q) as x0, min(n) as y0, max(q + h) as x1, max(n + 2) as y1 from {_L} group by k",
    "evidence_of_latest_run": """
select user_id as document_id, day(ts)::integer as run_id, event_id as field, event_type as evidence from events e where event_id % 3 <> 0 and day(ts) = (select max(day(ts)) from events x where x.user_id = e.user_id)""",
}
