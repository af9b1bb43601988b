"""DuckDB SQL for the engine's queries, written against the tables and not from the operators."""

from __future__ import annotations

_DOCS = """(select o_orderkey as document_id, case o_orderstatus when 'F' then 'VERIFIED' when 'O' then 'NEEDS_REVIEW' else 'PROCESSING' end as status,
  case when o_orderkey % 13 = 0 then '' else o_orderpriority end as file_type, o_orderdate as uploaded_at,
  case when o_orderkey % 11 <> 0 then cast((o_orderkey % 101) / 100.0 as decimal(6,2)) end as confidence, o_custkey from orders)"""
_EMAIL, _PHONE = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"
_DATE, _MONEY = "[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "[$€£₹] ?[0-9][0-9,]*([.][0-9]{2})?"
_FOUND = " union all ".join(f"select doc_id, source, '{k}' as kind, regexp_extract_all(text, '{p}') as found from documents" for k, p in (("email", _EMAIL), ("phone", _PHONE), ("date", _DATE), ("money", _MONEY)))
_SPACES = r"regexp_replace(lower(regexp_replace(x, '[•●▪◦\x00-\x1f]', ' ', 'g')), '\s+', ' ', 'g')"
_FORM = f"trim(translate({_SPACES}, '“”‘’–—', '\"\"''''--'))"

ORACLES: dict[str, str] = {
    "invoice_round_trip": """
with o as (select o_orderkey as k, o_orderdate as d, case when o_orderkey % 7 = 0 then 0 else cast(o_totalprice as decimal(18,2)) end as t from orders)
select k as doc_id, case when k % 10 <> 0 then 'Acme Works ' || k || ' Ltd' end as vendor_name, 'INV-2024-' || lpad(k::varchar, 8, '0') as invoice_number,
  strftime(d, '%Y-%m-%d') as invoice_date, t::double as total_amount,
  concat_ws('; ', case when k % 10 = 0 then 'Vendor Name is required' end, case when t <= 0 then 'Total Amount must be greater than 0' end) as errors,
  case when k % 10 = 0 or t <= 0 then 'NEEDS_REVIEW' else 'VERIFIED' end as status from o""",
    "dashboard_status_counts": f"select status, count(*) as n from {_DOCS} group by status",
    "dashboard_type_counts": f"select case when coalesce(file_type, '') = '' then 'UNKNOWN' else file_type end as file_type, count(*) as n from {_DOCS} group by 1",
    "dashboard_summary": f"""
select count(*) as total, count(*) filter (status = 'VERIFIED') as verified, count(*) filter (status = 'NEEDS_REVIEW') as needs_review, count(*) filter (status = 'FAILED') as failed,
  count(*) filter (status = 'PROCESSING') as processing, round(avg(confidence), 4)::double as average_confidence,
  round(100 * count(*) filter (status = 'VERIFIED') / count(*) filter (status in ('VERIFIED', 'NEEDS_REVIEW')), 2)::double as accuracy_rate,
  round(100 * count(*) filter (status = 'VERIFIED') / count(confidence), 1)::double as automation_rate, count(*) filter (confidence >= 0.85) as high,
  count(*) filter (confidence >= 0.70 and confidence < 0.85) as medium, count(*) filter (confidence < 0.70) as low, count(*) filter (confidence < 0.85) as review_required from {_DOCS}""",
    "confidence_tiers": f"select case when confidence >= 0.85 then 'high' when confidence >= 0.70 then 'medium' else 'low' end as tier, count(*) as n from {_DOCS} where confidence is not null group by 1",
    "list_page": f"select document_id, status, file_type from {_DOCS} where status = 'VERIFIED' order by uploaded_at desc, document_id desc limit 20 offset 20",
    "review_queue": f"select document_id, c_name from (select * from {_DOCS} where status = 'NEEDS_REVIEW' order by uploaded_at desc, document_id desc limit 50) left join customer on c_custkey = o_custkey",
    "search_documents": "select distinct d.doc_id, d.lang from documents d left join labels l on l.doc_id = d.doc_id where d.text ilike '%apache%' or d.source ilike '%apache%'",
    "display_coalesce": "select s_suppkey, case when s_suppkey % 3 <> 0 and s_name <> '' then s_name when s_suppkey % 5 <> 0 then 'key ' || s_suppkey else s_acctbal::varchar end as shown from supplier",
    "field_detection_rates": f"select kind as field, count(*) filter (len(found) > 0) as detected, round(100.0 * count(*) filter (len(found) > 0) / count(*), 1)::double as detection_rate from ({_FOUND}) group by kind",
    "field_source_histogram": f"select kind as field, source, count(*) as documents, sum(len(found))::bigint as occurrences from ({_FOUND}) where len(found) > 0 group by all",
    "pattern_detect": f"select doc_id, kind, len(found)::bigint as n, found[1] as first_value from ({_FOUND}) where len(found) > 0",
    "prepared_lines": r"""
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::integer as line_no, line from (
  select doc_id, i, trim(regexp_replace(l[i], '[ \t]+', ' ', 'g')) as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split_regex(text, '\r\n|\r|\n') as l from documents))) where line <> ''""",
    "latest_run": "select user_id, ts, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "compare_runs": """
with c as (select user_id, event_type, day(ts) <= 15 as f, count(*) as n from events group by all), a as (select * from c where f), b as (select * from c where not f)
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_type, b.event_type) as event_type, a.n as value_a, b.n as value_b,
  case when a.n is null then 'added' when b.n is null then 'removed' when a.n = b.n then 'same' else 'changed' end as change from a full join b on a.user_id = b.user_id and a.event_type = b.event_type""",
    "canonical_alias": "select case lower(event_type) when 'click' then 'interaction' when 'view' then 'impression' when 'purchase' then 'conversion' else event_type end as canonical_key, count(*) as n from events group by 1",
    "seed_missing": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and isodow(o_orderdate) = 5)",
    "normalize_date_round_trip": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders",
    "normalize_amount_round_trip": "select o_orderkey, (cast(o_totalprice as decimal(18,2)) * case when o_orderkey % 5 in (2, 4) then -1 else 1 end)::double as amount from orders",
    "normalize_money_percent": "select l_orderkey, l_linenumber, (cast(l_extendedprice as decimal(18,2)) * case when l_linenumber % 2 = 0 and l_extendedprice < 999.995 then 100 else 1 end)::double as price, (case when cast(l_discount as decimal(4,2)) > 0 then 100 else 1 end * cast(l_discount as decimal(4,2)))::double as discount from lineitem",
    "normalize_contacts": f"select doc_id, lower(nullif(regexp_extract(text, '{_EMAIL}'), '')) as email, regexp_replace(nullif(regexp_extract(text, '{_PHONE}'), ''), '[^0-9+]', '', 'g') as phone from documents where regexp_matches(text, '{_EMAIL}') or regexp_matches(text, '{_PHONE}')",
    "invoice_validation": """
select o_orderkey as document_id, e as errors, e = '' as is_valid from (select o_orderkey, concat_ws('; ', case when o_orderkey % 9 = 0 then 'Vendor Name is required' end, case when o_orderkey % 8 = 0 then 'Invoice Number is required' end,
  case when o_orderkey % 7 = 0 then 'Invoice Date is invalid' end, case when o_orderkey % 5 = 0 or o_totalprice <= 0 then 'Total Amount must be greater than 0' end) as e from orders)""",
    "route_v1": """
with c as (select o_orderkey as k, [o_orderkey % 40 + 61, o_orderkey * 3 % 40 + 61, o_orderkey * 7 % 40 + 61, o_orderkey * 11 % 40 + 61] as c from orders),
w as (select k, c, round(list_sum(c) / 400.0, 4) as o, len(list_filter(c, lambda x: x < 85)) as low from c)
select k as document_id, o::double as overall, case when low = 0 and o >= 0.85 then 'VERIFIED' else 'NEEDS_REVIEW' end as status, (low + case when o < 0.85 then 1 else 0 end)::bigint as n_reasons from w""",
    "score_v2": """
with x as (select l_orderkey, l_linenumber, l_linenumber as n, l_quantity::int as q, cast(1 - l_discount * 5 as decimal(10,4)) as ocr from lineitem),
s as (select *, cast(0.70 + (q % 4) * 0.1 as decimal(10,4)) * 0.35 + (case when n % 3 >= 2 then case when n % 2 = 0 then 1.0 else 0.55 end else 0.88 end) * 0.25 + (case when q % 5 <> 0 then 1.0 else 0.40 end) * 0.25
  + (greatest(0, 1 - (q % 3) * 0.3) * 0.6 + greatest(0.5, least(1, ocr)) * 0.4) * 0.15 as t from x),
r as (select *, case when q % 10 = 0 then 0.0 when q % 7 = 0 then 0.35 else round(least(0.99, greatest(0.1, cast(t as decimal(12,6)))), 2) end::double as confidence from s)
select l_orderkey, l_linenumber, confidence, case when confidence >= 0.85 and q % 5 <> 0 and q % 7 <> 0 then 'verified' else 'needs_review' end as status from r""",
    "schema_fingerprint": """
with w as (select doc_id, lang, source, string_split(text, ' ')[1:6] as w from documents)
select doc_id, left(sha256(lower(lang) || '|' || lower(source) || '|' || array_to_string(list_sort(w[1:2])[1:4], ',') || '|' || array_to_string(list_sort(w), ',')), 16) as fingerprint from w""",
    "exact_duplicates": "select sha256(text) as file_hash, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1",
    "redact_text": r"""
select conv_id, turn, sha256(regexp_replace(regexp_replace(regexp_replace('postgres://u:pw@h ' || text || ' Bearer abc.def sk-abcdefgh1234', '(://[^:/@\s]+):[^@/\s]+@', '\1:***@', 'g'), '(?i)bearer [A-Za-z0-9._-]+', 'Bearer ***', 'g'), '(sk-|AIza)[A-Za-z0-9_-]{8,}', '\1***', 'g')) as hash from conversations""",
    "truncate_head_tail": "select doc_id, sha256(case when length(text) <= 1000 then text else left(text, 600) || chr(10) || '...' || chr(10) || right(text, 400) end) as hash from documents",
    "ground_passages": f"""
with b as (select item_id, i - 1 as line_no, {_FORM.replace('(x,', '(p[i],')} as quote from (select item_id, p, unnest(range(1, len(p) + 1)) as i from (select item_id, string_split(text, chr(10)) as p from benchmark))),
d as (select doc_id, i, {_FORM.replace('(x,', '(p[i],')} as block from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, string_split(text, chr(10)) as p from documents)))
select doc_id, item_id, line_no::bigint as line_no, (min(i) - 1)::bigint as block_no from d, b where quote <> '' and contains(' ' || block || ' ', ' ' || quote || ' ') group by all""",
    "reconcile_rule_ai": """
with r as (select o_orderkey as k, 'T-' || o_orderkey as v, cast((o_orderkey * 7 % 30 + 60) / 100.0 as decimal(6,4)) as c, o_orderkey % 5 = 0 as bad from orders where o_orderkey % 11 <> 0),
m as (select o_orderkey as k, case o_orderkey % 3 when 0 then 't-' || o_orderkey || ' ' when 1 then 'T-' || o_orderkey || '9' else 'other' end as v, cast((o_orderkey * 5 % 30 + 65) / 100.0 as decimal(6,4)) as c, o_orderkey % 7 = 0 as bad from orders where o_orderkey % 13 <> 0),
j as (select coalesce(r.k, m.k) as k, r.v as rv, m.v as mv, r.c as rc, m.c as mc, r.bad as rb, m.bad as mb,
  case when r.bad and not m.bad then false when m.bad and not r.bad then true else r.c >= m.c end as rule from r full join m on r.k = m.k)
select k as doc_id, 'total_amount' as field, case when mv is null then rv when rv is null then mv when k % 3 = 0 or rule then rv else mv end as value,
  round(case when mv is null then rc when rv is null then mc when k % 3 = 0 then least(1, greatest(rc, mc) + 0.05)
    when rb = mb and k % 3 = 2 and (least(rc, mc) >= 0.70 or abs(rc - mc) <= 0.15) then greatest(0.35, least(case when rule then rc else mc end - 0.20, 0.75))
    else case when rule then rc else mc end end, 2)::double as confidence,
  case when mv is null then 'rule' when rv is null then 'ai' when k % 3 = 0 then 'rule+ai' when rule then 'rule' else 'ai' end as source from j""",
    "sum_equals": "select distinct l_orderkey, case when l_orderkey % 4 = 3 then 'skipped' when l_orderkey % 4 = 2 then 'fail' else 'pass' end as outcome from lineitem",
    "running_balance": """
with e as (select user_id, event_id, ts, cast(value as decimal(18,2)) as credit, case when event_id % 4 <> 0 then cast(event_id % 100 as decimal(18,2)) end as balance from events where user_id is not null),
b as (select *, last_value(balance ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from e)
select user_id, count(*) filter (abs(balance - (before + coalesce(credit, 0))) > 0.05) as mismatches, count(before) as compared from b group by user_id""",
    "declared_rules": """
select case when o_orderdate <= l_shipdate then 'pass' else 'fail' end as date_order, case when l_quantity between 5 and 45 then 'pass' else 'fail' end as in_range,
  case when regexp_matches(o_orderpriority, '^[12]-') then 'pass' else 'fail' end as regex_match, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by all""",
    "insights_per_order": """
select l_orderkey, count(*) as n_rows, sum(v)::double as sum_value, ((2 * (sum(v) * 100)::bigint + count(v)) // (2 * count(v)) / 100.0)::double as avg_value, min(v)::double as min_value, max(v)::double as max_value
from (select l_orderkey, cast(l_extendedprice as decimal(18,2)) as v from lineitem) group by 1""",
    "coverage_insights": "select l_orderkey as doc_id, count(*) filter (l_quantity > 10) || '/' || count(*) || ' grounded (' || count(*) filter (l_discount > 0.05) || ' verified)' as insight from lineitem group by 1",
    "table_profile": "\nunion all\n".join(
        f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as missing, count(distinct {c}) as distinct_values, "
        + (f"min({c})::double as min_value, max({c})::double as max_value, round(avg(cast({c} as decimal(18,4))), 2)::double as mean_value" if n else "null::double as min_value, null::double as max_value, null::double as mean_value")
        + " from customer"
        for c, n in (("c_custkey", 1), ("c_name", 0), ("c_nationkey", 1), ("c_acctbal", 1), ("c_mktsegment", 0))
    ),
    "corrections_overlay": """
with e as (select l_orderkey, max(l_linenumber) as n from lineitem where l_linenumber > 3 group by 1)
select o_orderkey as document_id, case when n is null then o_orderpriority else 'edit ' || n end as value, case when n is null then 0.5 else 1.0 end::double as confidence, case when n is null then 'rule' else 'human' end as source from orders left join e on l_orderkey = o_orderkey""",
    "audit_diff": "select c_custkey, 'HUMAN_CORRECTION' as action, c_mktsegment as original_value, 'REVIEWED' as corrected_value from customer where c_custkey % 10 = 0",
    "upsert_records": """
select c_custkey, c_name from customer where c_custkey % 8 <> 4 union all select c_custkey + case when c_custkey % 8 = 0 then 10000000 else 0 end, 'new' from customer where c_custkey % 4 = 0""",
    "cascade_delete": "select (select count(*) from orders where o_orderstatus <> 'F') as orders_left, (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')) as lines_left",
    "json_export": """select c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","segment":"' || c_mktsegment || '"}' as document from customer""",
    "events_tumbling": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(cast(value as decimal(18,6))), 4)::double as total from events group by all",
    "events_sliding": "select w as window_start, count(*) as n from (select unnest([time_bucket(interval 12 hours, ts, timestamp '1970-01-01'), time_bucket(interval 12 hours, ts, timestamp '1970-01-01') - interval 12 hours]) as w from events) group by 1",
    "events_sessions": """
with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events where user_id is not null),
g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from s)
select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from g group by user_id, g""",
}

_TYPES = "['application_form', 'bank_statement', 'certificate', 'contract', 'delivery_challan', 'expense_report', 'id_document', 'insurance', 'invoice', 'medical_report', 'purchase_order', 'receipt', 'resume']"
ORACLES["classify_documents"] = f"""
select ({_TYPES})[o_orderkey % 13 + 1] as known_type, ({_TYPES})[o_orderkey % 13 + 1] as doc_type, count(*) as n from orders group by all
union all select 'none', 'invoice', count(*) from documents"""
ORACLES["ground_values"] = """
with o as (select o_orderkey as k, 'INV-24-' || lpad(o_orderkey::varchar, 8, '0') as number, 'Customer ' || o_custkey as customer, case when o_orderkey % 10 = 0 then 0 else 1 end as v, case when o_orderkey % 3 = 0 then 1 else 0 end as d from orders)
select k as doc_id, 'invoice_number' as field, 'b' || (1 + v) as block_id, 0.95::double as match_score, true as grounded from o
union all select k, 'customer', 'b' || (4 + v + d), 0.95::double, true from o"""

ORACLES["ground_likeness"] = """
with o as (select o_orderkey as k, case when o_orderkey % 10 = 0 then 0 else 1 end as v, case when o_orderkey % 3 = 0 then 1 else 0 end as d, length('invoice number: inv-24-' || lpad(o_orderkey::varchar, 8, '0')) as n from orders)
select k as doc_id, 'misread' as field, 'b' || (1 + v) as block_id, round((n - 1.0) / n, 2)::double as match_score, true as grounded from o
union all select k, 'turned', 'b' || (6 + v + d), 1.0::double, true from o
union all select k, 'absent', null, 0.0::double, false from o"""

ORACLES |= {
    "cleaned_text": r"""
with r as (select doc_id, ' ' || chr(13) || chr(10) || replace(text, '.', chr(13)) || '  ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10) || ' end ' || ' ' as t from documents),
a as (select doc_id, regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t\f\x0b]+(\n|$)', '\1', 'g') as t from r)
select doc_id, sha256(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as hash from a""",
    "kv_line_lookup": "select o_orderkey as doc_id, 'due_date' as label, strftime(o_orderdate + interval 30 days, '%d/%m/%Y') as value from orders union all select o_orderkey, 'bill_to', 'Customer ' || o_custkey from orders",
    "resume_sections": "select c_custkey as doc_id, 'skills' as section, c_mktsegment || chr(10) || 'sql' as content from customer union all select c_custkey, 'education', 'College ' || c_nationkey from customer",
    "rows_as_text": "select s_suppkey, 's_suppkey: ' || s_suppkey || ', s_name: ' || s_name || case when s_suppkey % 3 <> 0 then ', s_nationkey: ' || s_nationkey else '' end as row_text from supplier",
    "audit_events": f"""
select 'DOCUMENT_UPLOADED' as action, count(*) as n, max(uploaded_at) as last_at from {_DOCS} union all
select case status when 'VERIFIED' then 'DOCUMENT_VERIFIED' else 'ROUTED_TO_REVIEW' end, count(*), max(uploaded_at) from {_DOCS} where status in ('VERIFIED', 'NEEDS_REVIEW') group by 1""",
    "review_messages": f"select document_id, case when document_id % 4 = 0 then 'a|b' when status = 'NEEDS_REVIEW' then 'low total|no date' else '' end as messages from {_DOCS}",
    "file_names": "with u as (select page_id, list_last(string_split('..' || chr(92) || 'up/' || case when page_id % 2 = 0 then '.' else '' end || regexp_replace(url, '^https?:', ''), '/')) as n from pages) select page_id, coalesce(nullif(regexp_replace(n, '^\\.+', ''), ''), 'unnamed_document') as name from u",
    "multi_type_extract": """
with o as (select o_orderkey as k, o_orderkey % 13 as m, o_custkey as c, strftime(o_orderdate, '%Y-%m-%d') as d, cast(cast(o_totalprice as decimal(18,2)) as varchar) as t from orders),
f as (select k, 'application_form' as doc_type, unnest([{'f': 'applicant_name', 'v': 'Ann Lee', 'c': 0.85}, {'f': 'application_number', 'v': 'AF-' || k, 'c': 0.90}, {'f': 'address', 'v': c || ' High Street', 'c': 0.80}]) as x from o where m = 0
  union all select k, 'bank_statement', unnest([{'f': 'account_holder', 'v': 'C ' || c, 'c': 0.85}, {'f': 'account_number', 'v': k::varchar, 'c': 0.90}, {'f': 'transaction_date', 'v': d, 'c': 0.80}, {'f': 'balance_amount', 'v': t, 'c': 0.85}]) from o where m = 1
  union all select k, 'certificate', unnest([{'f': 'certificate_type', 'v': 'Certificate of Merit', 'c': 0.80}, {'f': 'person_name', 'v': 'Jo Novak', 'c': 0.85}, {'f': 'institution_name', 'v': 'North College', 'c': 0.80}, {'f': 'certificate_id', 'v': 'C/' || k, 'c': 0.85}, {'f': 'issue_date', 'v': d, 'c': 0.80}]) from o where m = 2
  union all select k, 'contract', unnest([{'f': 'parties', 'v': 'A' || c || ' and B', 'c': 0.80}, {'f': 'effective_date', 'v': d, 'c': 0.85}, {'f': 'expiry_date', 'v': '2030-01-01', 'c': 0.85}, {'f': 'contract_value', 'v': '$' || t, 'c': 0.80}]) from o where m = 3
  union all select k, 'delivery_challan', unnest([{'f': 'challan_number', 'v': 'DC-' || k, 'c': 0.90}, {'f': 'challan_date', 'v': d, 'c': 0.85}, {'f': 'supplier_name', 'v': 'S' || c, 'c': 0.80}, {'f': 'customer_name', 'v': 'R' || k, 'c': 0.80}]) from o where m = 4
  union all select k, 'expense_report', unnest([{'f': 'employee_name', 'v': 'Kim Marsh', 'c': 0.85}, {'f': 'expense_date', 'v': d, 'c': 0.85}, {'f': 'total_amount', 'v': t, 'c': 0.85}]) from o where m = 5
  union all select k, 'id_document', unnest([{'f': 'id_number', 'v': 'I' || k, 'c': 0.90}, {'f': 'person_name', 'v': 'Lou Weber', 'c': 0.80}, {'f': 'date_of_birth', 'v': d, 'c': 0.85}, {'f': 'address', 'v': 'Flat ' || c, 'c': 0.80}]) from o where m = 6
  union all select k, 'insurance', unnest([{'f': 'policy_number', 'v': 'P/' || k, 'c': 0.90}, {'f': 'policy_holder', 'v': 'Max Rossi', 'c': 0.85}, {'f': 'start_date', 'v': d, 'c': 0.80}, {'f': 'expiry_date', 'v': '2030-01-01', 'c': 0.80}, {'f': 'premium_amount', 'v': t, 'c': 0.85}]) from o where m = 7
  union all select k, 'invoice', unnest([{'f': 'vendor_name', 'v': 'Acme ' || c, 'c': 0.80}, {'f': 'invoice_number', 'v': 'N-' || k, 'c': 0.85}, {'f': 'invoice_date', 'v': d, 'c': 0.85}, {'f': 'total_amount', 'v': t, 'c': 0.85}, {'f': 'tax_amount', 'v': '7.50', 'c': 0.75}]) from o where m = 8
  union all select k, 'medical_report', unnest([{'f': 'patient_name', 'v': 'Eva Keller', 'c': 0.85}, {'f': 'report_date', 'v': d, 'c': 0.85}, {'f': 'test_name', 'v': 'T' || c, 'c': 0.80}, {'f': 'test_result', 'v': t || ' mg', 'c': 0.80}, {'f': 'reference_range', 'v': '1 - 5', 'c': 0.75}, {'f': 'doctor_name', 'v': 'Dr. Ida Dubois', 'c': 0.80}]) from o where m = 9
  union all select k, 'purchase_order', unnest([{'f': 'po_number', 'v': 'PO-' || k, 'c': 0.90}, {'f': 'buyer_name', 'v': 'Cust ' || c, 'c': 0.85}, {'f': 'order_date', 'v': d, 'c': 0.85}, {'f': 'total_amount', 'v': '$' || t, 'c': 0.85}]) from o where m = 10
  union all select k, 'receipt', unnest([{'f': 'store_name', 'v': 'Corner Shop', 'c': 0.80}, {'f': 'receipt_number', 'v': k::varchar, 'c': 0.85}, {'f': 'receipt_date', 'v': d, 'c': 0.85}, {'f': 'total_amount', 'v': t, 'c': 0.85}, {'f': 'payment_method', 'v': 'VISA', 'c': 0.80}]) from o where m = 11
  union all select k, 'resume', unnest([{'f': 'email', 'v': 'mail' || c || '@x.org', 'c': 0.95}, {'f': 'phone', 'v': '+1 (555) 123-4567', 'c': 0.90}, {'f': 'education', 'v': 'Bachelor of Arts, ' || c, 'c': 0.80}, {'f': 'experience', 'v': k || ' years of experience in law', 'c': 0.80}]) from o where m = 12)
select k as doc_id, doc_type, x.f as field, x.v as value, x.c::double as confidence from f""",
}

ORACLES |= {
    "ocr_lines": """
select o_orderkey as doc_id, 1 as line, 'Invoice Number: N-' || o_orderkey as text, 0.0::double as x0, 190.0::double as x1, 0.92::double as confidence from orders
union all select o_orderkey, 2, strftime(o_orderdate, '%Y-%m-%d'), 200.0::double, 240.0::double, 0.8::double from orders""",
    "spatial_neighbours": "select o_orderkey as doc_id, 'Number:' as keyword, 'N-' || o_orderkey as value from orders",
    "schema_resolution": """
select p_partkey as doc_id, p_type as doc_type, case when p_size = 17 then 's1' when lower(p_type) like '%promo%' then 's1' when lower(p_type) like '%anodized%' then 's2' end as schema_id,
  case when p_size = 17 then 'fingerprint' when lower(p_type) like '%promo%' or lower(p_type) like '%anodized%' then 'name' else 'none' end as how from part""",
    "canonical_keys": """
select case when event_id % 2 = 1 then 'odd' else 'even' end as family, case lower(event_type) when 'click' then 'interest' when 'purchase' then case when event_id % 2 = 1 then 'bought_now' else 'bought' end else lower(event_type) end as canonical_key,
  count(*) as n from events group by all""",
}
