"""The conversation trie in DuckDB SQL, by comparing whole prefixes, for the driver's comparison."""

from __future__ import annotations

from .shard_sql import crc_of


def oracle() -> str:
    said = "sha256(length(role) || ':' || role || text)"
    return f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, {said} as said, strlen(text) as bytes, row_number() over (partition by conv_id order by turn nulls first, {said}) as place from t),
c as (select conv_id, max(place) as n, {crc_of("cast(conv_id as varchar)")} % 9 as h, conv_id - conv_id % 5 as base from o group by conv_id),
l as (select c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) as lead from c left join c b on b.conv_id = c.base),
r as (select l.conv_id, o.place - l.h + l.lead as place, o.said, o.bytes from o join l using (conv_id) where o.place > l.h
  union all select l.conv_id, o.place, o.said, o.bytes from o join l on o.conv_id = l.base where o.place <= l.lead),
s as (select l.conv_id, coalesce(list(r.said order by r.place) filter (r.place is not null), []) as said, coalesce(list(r.bytes order by r.place) filter (r.place is not null), []) as bytes from l left join r using (conv_id) group by l.conv_id),
p as (select conv_id, unnest(range(0, len(said) + 1)) as depth, said, bytes from s),
n as (select depth, said[1:depth] as k, min(conv_id) as node, count(*) as n_convs, coalesce(max(bytes[depth]), 0) as bytes,
  sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(said) = depth), '')) as ends_sha256 from p group by 1, 2),
m as (select p.conv_id, p.depth, n.node from p join n on n.depth = p.depth and n.k = p.said[1:p.depth]),
u as (select n.*, m.node as parent from n left join m on m.conv_id = n.node and m.depth = n.depth - 1),
k as (select parent as node, depth - 1 as depth, count(*) as n_children from u where depth > 0 group by 1, 2),
a as (select m.node, m.depth, sum((u.n_convs - 1) * u.bytes) as saved, count(*) filter (k.n_children is null) as n_leaves
  from u left join k on k.node = u.node and k.depth = u.depth join m on m.conv_id = u.node and m.depth <= u.depth group by 1, 2)
select u.node as conv_id, cast(u.depth as bigint) as depth, u.parent as parent_conv_id, u.n_convs, coalesce(k.n_children, 0) as n_children, a.n_leaves, cast(a.saved as bigint) as saved_tokens, u.ends_sha256
from u join a on a.node = u.node and a.depth = u.depth left join k on k.node = u.node and k.depth = u.depth"""
