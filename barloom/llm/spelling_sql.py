"""Spelling variants in DuckDB SQL: equal words with a gap, for the driver's comparison."""

from __future__ import annotations

from .common import LOWER, UPPER
from .shard_sql import folded, table


def oracle() -> str:
    values = "list_transform(range(0, length(h) // 2), lambda i: cast(('0x' || substr(h, 2 * i + 1, 2)) as bigint))"
    return f"""with recursive r as (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) as run from documents),
c as (select coalesce(cast(doc_id as varchar), '') as key, run, count(*) as k from r where length(run) >= 7 group by 1, 2),
h as (select *, hex(encode(key || ':' || run)) as h, {table()} :: bigint[] as tab from c), x as materialized (select run, k, {folded('tab', values)} as crc from h),
y as (select case when crc % 31 = 0 then substr(run, 1, cast(crc % length(run) as bigint)) || substr(run, cast(crc % length(run) as bigint) + 2) else run end as word, k from x),
w as materialized (select word, cast(sum(k) as bigint) as n from y where length(word) >= 7 group by word having sum(k) >= 2),
g as materialized (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from (select *, unnest(range(1, length(word) + 1)) as i from w)),
p as (select g.word, o.word as other, o.n from g join g o on g.a = o.a and g.b = o.b and g.i = o.i where g.word <> o.word),
d as (select distinct g.word as long, w.word as short, g.n as long_n, w.n as short_n from g join w on w.word = g.a || g.b),
e as (select * from p union all select long, short, short_n from d union all select short, long, long_n from d),
b as (select word, count(*) as n_near, max(n) as best_n from e group by word),
f as (select e.word, min(e.other) as best from e join b on b.word = e.word and b.best_n = e.n group by e.word),
v as materialized (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.best_n >= 10 * w.n then f.best end as form, case when b.best_n >= 10 * w.n then b.best_n end as form_n from w left join b on b.word = w.word left join f on f.word = w.word),
z as (select word, form as root, 1 as steps from v where form is not null union all select z.word, v.form, z.steps + 1 from z join v on v.word = z.root where v.form is not null),
l as (select word, arg_max(root, steps) as root from z group by word)
select v.word, v.form, coalesce(l.root, v.word) as root, v.n, v.n_near, v.form_n from v left join l on l.word = v.word"""
