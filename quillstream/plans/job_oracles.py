"""DuckDB SQL for the queries over runs, merged tables, files and fields of runs."""

from __future__ import annotations

from quillstream.streaming.runs import STAGES

_STAGES = "[" + ", ".join(f"'{s}'" for s in (*STAGES, "FAILED", "ODD", "UPLOADED", "INGESTION", "CLASSIFYING", "EXTRACTING")) + "]"
_SCORE = "round(least(0.99, greatest(0.1, cast(cast(0.7 + n % 3 * 0.1 as decimal(10,4)) * 0.35 + (case when n % 3 >= 2 then 1.0 else 0.88 end) * 0.25 + (case when n <> 5 then 1.0 else 0.40 end) * 0.25 + (greatest(0, 1 - (k % 2) * 0.3) * 0.6 + cast(0.7 + n % 3 * 0.1 as decimal(10,4)) * 0.4) * 0.15 as decimal(12,6)))), 2)"

ORACLES: dict[str, str] = {
    "run_stages": f"""
with e as (select user_id || '/' || strftime(ts, '%Y-%m-%d') as run_id, {_STAGES}[event_id % 15 + 1] as stage, case when event_id % 2 = 0 then 'VERIFIED' else 'NEEDS_REVIEW' end as status, 'm' || event_id % 7 as message, epoch_us(ts) as us from events where user_id is not null),
k as (select * from e where stage <> 'ODD'),
t as (select run_id, min(struct_pack(us := us, stage := stage, status := status, message := message)) as t from k where stage in ('COMPLETED', 'FAILED') group by run_id),
f as (select run_id, stage, list_position({_STAGES}, stage) - 1 as rank, min(us) as us from k where stage <> 'FAILED' group by run_id, stage),
s as (select f.run_id, max(rank) as rank, min(f.us) as started, count(*) as n from f left join t using (run_id) where t.t is null or f.us <= t.t.us group by f.run_id),
l as (select run_id, max(us) as last from k group by run_id),
a as (select l.run_id, {_STAGES}[s.rank + 1] as stage, t.t as t, least(coalesce(s.started, t.t.us), coalesce(t.t.us, s.started)) as started, coalesce(t.t.us, l.last) as last, coalesce(s.n, 0) as n, s.rank,
  t.t is null and l.last + 1800 * 1000000 < (select max(epoch_us(ts)) from events) as silent from l left join s using (run_id) left join t using (run_id)),
b as (select *, case when t is not null then case when t.stage = 'FAILED' then 'FAILED' else t.status end when silent then 'FAILED' when rank = 0 then 'QUEUED' else 'PROCESSING' end as st from a)
select run_id, stage, st as status, case when t is not null then t.message when silent then 'No event for 1800 seconds' else '' end as message, case when st not in ('QUEUED', 'PROCESSING') then round((last - started) / 1000000.0, 6) end::double as seconds, n::int as n_stages from b""",
    "keyed_merge": "select user_id, event_type, max(event_id) as event_id, arg_max(cast(value as decimal(18,2)), event_id)::double as value from events where user_id is not null group by all",
    "partition_overwrite": "select o_orderkey, o_orderpriority, o_orderstatus from orders where o_orderstatus <> 'O' union all select o_orderkey, 'new', o_orderstatus from orders where o_orderstatus = 'O' and o_orderkey % 2 = 0",
    "file_types": """
with p as (select page_id as k, strlen(coalesce(html, '')) as n, page_id % 8 as t from pages),
f as (select k || case when k % 16 = 7 then '.csv' else '.dat' end as file_name, ['PDF', 'IMAGE', 'IMAGE', 'EXCEL', 'CSV', 'UNSUPPORTED', 'UNSUPPORTED', 'UNSUPPORTED'][t + 1] as file_type, [n + 9, n + 8, n + 3, n + 20, 7, n + 1, 0, 4][t + 1] as file_size from p)
select *, case when file_type = 'UNSUPPORTED' then 'FAILED' else 'UPLOADED' end as status, case when file_size = 0 then 'File is empty' when file_type = 'UNSUPPORTED' then 'Unsupported file type' end as error_message from f""",
    "csv_round_trip": """select s_suppkey::varchar as s_suppkey, 'the "' || s_name || '", ltd' as s_name, cast(s_acctbal as decimal(12,2))::varchar as s_acctbal, case when s_suppkey % 3 <> 0 then s_nationkey::varchar end as s_nationkey from supplier""",
    "delimited_files": "select s_nationkey::int as nation, 'key|name|name_2' as headers, s_suppkey || '|' || s_name || ', x|-' as cells from supplier",
    "decoded_files": "select s_suppkey, s_name || ' é' as name from supplier",
    "workbook_cells": """
with s as (select s_suppkey as k, regexp_replace(s_name, '[<>&]', '', 'g') as name, '/in/' || s_suppkey || '.xlsx' as path, 'S' || s_suppkey % 3 as sheet from supplier)
select path, sheet, 0 as row_idx, 0 as col_idx, name as value, false as broken from s where k % 7 <> 0 union all select path, sheet, 0, 2, k::varchar, false from s where k % 7 <> 0 union all select path, sheet, 1, 27, 'true', false from s where k % 7 <> 0
union all select path, null, null, null, null, true from s where k % 7 = 0""",
    "word_blocks": """
with s as (select s_suppkey as k, regexp_replace(s_name, '[<>&]', '', 'g') as name, '/in/' || s_suppkey || '.docx' as path from supplier)
select path, 0 as reading_order, 'heading' as type, name as text, null::varchar as error_message from s union all select path, 1, 'table', 'key | ' || k, null from s""",
    "review_item_rows": """
select o_orderkey as document_id, 'number' as field, case when o_orderkey % 2 = 0 then 'N' else '' end || o_orderkey as value, o_orderkey::varchar as original, 0.9::double as confidence, 'rule' as source from orders
union all select o_orderkey, 'status', o_orderstatus, o_orderpriority, 0.5, 'rule' from orders""",
    "header_names": """
select s_suppkey, case when s_suppkey % 2 = 0 then 'column_1|name' else 'name|name_2' end || case when s_suppkey % 3 = 0 then '|column_3' when s_suppkey % 2 = 0 then '|name_2' else '|name_3' end || case when s_suppkey % 5 = 0 then '|column_4' else '|c' || s_suppkey end || '|column_5' as headers from supplier""",
    "schema_versions": """
select p_partkey::varchar as schema_id, case when p_partkey % 3 = 0 then 'revised' else p_name end as name, case when p_partkey % 3 = 0 then 2 else 1 end as version, p_size::varchar as fingerprint from part
where p_partkey % 4 <> 0 or (p_partkey % 3 = 0 and p_partkey % 2 = 0)""",
    "masked_values": "select c_custkey, case when c_custkey % 3 = 0 or length(c_name) <= 8 then '***' else left(c_name, 4) || '...' || right(c_name, 4) end as masked from customer",
    "custom_fields": """
with r as (select l_orderkey as d, arg_max('run' || l_linenumber, struct_pack(a := l_shipdate, b := 'run' || l_linenumber)) as run_id from lineitem where l_orderkey % 5 <> 0 group by 1)
select o_orderkey as document_id, run_id, case when run_id is not null then case when o_orderkey % 2 = 0 then 'weight' else 'net_weight' end end as canonical_key, case when run_id is not null then ['5.5', 'x', '1000.0'][o_orderkey % 3 + 1] end as normalized_value,
  case when run_id is not null then case when o_orderkey % 3 = 1 then 'Value ''x'' is not a valid money' else '' end end as messages, case when run_id is null then 'No active extraction run for document.' end as error_message
from orders left join r on r.d = o_orderkey""",
    "found_fields": """
select o_orderkey as doc_id, concat_ws('|', case when o_orderkey % 2 = 0 then 'vendor_name' end, 'invoice_number', case when o_orderkey % 3 <> 0 then 'total_amount' end) as found,
  concat_ws('|', case when o_orderkey % 2 <> 0 then 'vendor_name' end, 'invoice_date', case when o_orderkey % 3 = 0 then 'total_amount' end) as missing from orders""",
    "rescored_documents": f"""
with f as (select l_orderkey as k, l_linenumber as n from lineitem),
s as (select k, n, case when n = 4 and k % 2 = 1 then 0.0 when n = 6 then 0.35 else {_SCORE} end::decimal(10,4) as c from f)
select k as document_id, (((2 * sum(c * 100) + count(*))::bigint // (2 * count(*))) / 100.0)::double as confidence, case when bool_or(c < 0.85 or n = 6 or n = 5) then 'NEEDS_REVIEW' else 'VERIFIED' end as status from s group by k""",
    "listed_runs": "select l_orderkey as document_id, l_linenumber as run_id, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber) as rank from lineitem where l_orderkey in (select o_orderkey from orders)",
    "audit_order": "select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id) as rank from events where user_id is not null",
    "ranked_candidates": "select l_orderkey as doc_id, l_linenumber as pos, row_number() over (partition by l_orderkey order by cast(l_discount as decimal(4,2)) desc, l_linenumber) as rank from lineitem",
}
