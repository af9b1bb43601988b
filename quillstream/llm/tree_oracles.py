"""DuckDB SQL for the prefix trie and centroid clustering; SimHash has none, as SQL here has no XXH64."""

from __future__ import annotations

_OP11 = r"""
with recursive tab as (
  select list(list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t from range(256) r(i)),
ids as (select distinct conv_id as c from conversations where conv_id is not null),
hs as (
  select c, xor(list_reduce(list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::bigint), 4294967295) % 4 as h from ids, tab),
turns as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as n
  from conversations where conv_id is not null),
seqs as (select c, list({'r': r, 'x': x} order by n) as s from turns group by c),
built as (
  select seqs.c, list_concat(coalesce(base.s, [])[1 : h], seqs.s[h + 1 : len(seqs.s)]) as s from seqs join hs using (c) left join seqs base on base.c = seqs.c - seqs.c % 20),
rows as (select c, s, unnest(range(0, len(s) + 1)) as d from built),
nodes as (
  select s[1 : d] as p, d, min(c) as c, count(*) as n, count(*) filter (d = len(s)) as ends, coalesce(string_agg(c::varchar, ',' order by c) filter (d = len(s)), '') as e
  from rows group by s[1 : d], d),
own as (
  select *, (n = ends)::bigint as leaf, case when d = 0 then 0 else (n - 1) * len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) end as saved from nodes),
up as (select p[1 : k] as p, k, leaf, saved from (select *, unnest(range(0, d + 1)) as k from own)),
below as (select p, k, sum(leaf) as leaves, sum(saved) as saved from up group by p, k),
kids as (select p[1 : d - 1] as p, d - 1 as d, count(*) as n from nodes where d > 0 group by all)
select a.c as conv_id, a.d as depth, up.c as parent_conv_id, a.n as n_convs, coalesce(kids.n, 0) as n_children, below.leaves::bigint as n_leaves, below.saved::bigint as saved_tokens, sha256(a.e) as ends_sha256
from nodes a join below on below.k = a.d and below.p = a.p left join kids on kids.d = a.d and kids.p = a.p left join nodes up on up.d = a.d - 1 and a.d > 0 and up.p = a.p[1 : a.d - 1]
"""

_DISTANCE = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"


def _rounds(n: int) -> str:
    out = []
    for k in range(n):
        out.append(
            f"a{k} as materialized (select i, any_value(v.v) as v, arg_min(c, {_DISTANCE} * 8 + c) as c from v, c{k} c group by i), "
            f"s{k} as materialized (select c, e, sum(v[e])::bigint as s, count(*)::bigint as n from a{k}, range(1, 65) r(e) group by c, e), "
            f"c{k + 1} as materialized (select c, list((s - ((s % n) + n) % n) // n order by e) as v from s{k} group by c union all select c, v from c{k} where c not in (select c from s{k}))"
        )
    return ", ".join(out)


_OP13 = f"""
with v as materialized (
  select vec_id, row_number() over () as i, list_transform(embedding, lambda x: floor(greatest(-134217728, least(134217728, 1024 * x::double)))::bigint) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and not isnan(x) and not isinf(x))) = 64),
c0 as materialized (select row_number() over (order by vec_id is null, sha256('3:' || vec_id), v) - 1 as c, v from v order by vec_id is null, sha256('3:' || vec_id), v limit 8),
{_rounds(10)},
d as (select i, any_value(vec_id) as vec_id, min({_DISTANCE} * 8 + c) as m from v, c10 c group by i),
r as (select vec_id, (m % 8)::int as cluster, m // 8 as distance from d)
select r.vec_id, r.cluster, r.distance, (sum(r.distance) over (partition by r.cluster))::bigint as cluster_inertia, (sum(r.distance) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from r join c10 c on c.c = r.cluster
"""

ORACLES: dict[str, str] = {"op11_prefix_trie": _OP11, "op13_centroid_clustering": _OP13}
