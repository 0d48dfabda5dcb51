"""The quality rules in DuckDB SQL, for the driver's comparison."""

from __future__ import annotations

from .quality import CONSISTENCY, CUT, LEAST_ROWS, LINES, P, REPEAT, SHARE, SHORTEST, STEPS, UNIT, WORDS

COUNTS = r"""
t as materialized (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as materialized (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
u as materialized (select doc_id, unnest(range(1, len(words) - 1)) as i, words from w where len(words) > 3),
k as materialized (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as k from u),
r as (select doc_id, k from k group by 1, 2 having count(*) > 1),
p as (select distinct doc_id, unnest([i, i + 1, i + 2]) as i from k join r using (doc_id, k)),
c as (select doc_id, count(*) as n from p group by 1),
s as materialized (select w.doc_id, lang, source, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(coalesce(c.n, 0) as bigint) as n_repeat_words from w left join c on c.doc_id = w.doc_id),
"""


def vector() -> str:
    ratio = lambda a, b: f"coalesce(cast({a} as double) / nullif({b}, 0), 0.0)"
    raw = (
        f"ln((word_chars + {5.0 * WORDS}::double) / (n_words + {float(WORDS)}::double))", f"ln({ratio('n_symbols', 'n_words')} + 1.0)",
        f"asin(sqrt(cast(n_dup_lines as double) / (n_lines + {float(LINES)}::double)))", f"asin(sqrt(least({ratio('n_repeat_words', 'n_words')}, 1.0)))",
    )
    columns = ", ".join(f"cast(round(({r}) * {UNIT}) as bigint) as x{i}" for i, r in enumerate(raw))
    return f"v as materialized (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {columns} from s),\n"


def groups() -> str:
    return f"""pairs as (select lang, source, count(*) as n, count(*) < {LEAST_ROWS} as small from v where not base_failed group by 1, 2),
named as (select lang, source, case when not small then 'a' || coalesce('=' || lang, '-') || coalesce('=' || source, '-') when sum(n) over (partition by lang, small) >= {LEAST_ROWS} then 'l' || coalesce('=' || lang, '-') else 'rest' end as g from pairs),
f as materialized (select v.*, g from v join named on v.lang is not distinct from named.lang and v.source is not distinct from named.source where not base_failed),
"""


def floors() -> str:
    """One row of the four floors."""
    size = 5.0 * (SHORTEST + WORDS)
    half = lambda c: f"(select quantile_disc({c}, 0.5) from f)"
    return f"""fl as materialized (select ln({(size + 1) / size!r}::double) as f0, ln({1 / SHORTEST + 1!r}::double) as f1, asin(sqrt(1.0::double / (greatest({half('n_lines')}, 1) + {LINES}))) as f2,
 asin(sqrt({float(REPEAT)}::double / greatest({half('n_words')}, {SHORTEST}))) as f3),
"""


def cut_of(rows: str, by: str, share: float) -> str:
    return f"""(select {by}, min(bin) as cut from (select *, sum(n) over (partition by {by} order by bin) as upto, sum(n) over (partition by {by}) as every from (select {by}, bin, count(*) as n from {rows} group by {by}, bin)) where upto >= every * {share!r} group by {by})"""


ESTIMATE = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i in range(P) for j in range(i + 1)]


def distance(table: str, out: str) -> str:
    """Rows of f with y0.. and d2 by the estimates in `table`."""
    source = f"f join {table} using (g)"
    for i in range(P):
        v = f"cast(x{i} as double) / {UNIT} - m{i}" + "".join(f" - l{i}{j} * y{j}" for j in range(i))
        source = f"(select *, ({v}) / l{i}{i} as y{i} from {source})"
    sql = "0.0::double" + "".join(f" + y{i} * y{i}" for i in range(P))
    return f"{out} as materialized (select *, {sql} as d2 from {source}),\n"


def moments(k: int) -> str:
    sums = ", ".join([f"sum(x{i}) as s{i}" for i in range(P)] + [f"sum(x{i} * x{j}) as q{i}{j}" for i in range(P) for j in range(i + 1)])
    means = ", ".join(f"cast(s{i} as double) / n / {UNIT} as m{i}" for i in range(P))
    cov = ", ".join(
        f"{CONSISTENCY!r}::double * (cast(q{i}{j} as double) / n / {UNIT * UNIT} - m{i} * m{j}) + {f'f{i} * f{i}' if i == j else '0.0::double'} as c{i}{j}" for i in range(P) for j in range(i + 1)
    )
    source = f"(select *, {means} from (select g, start, count(*) as n, {sums} from near{k} join {cut_of(f'near{k}', 'g, start', SHARE)} using (g, start) where bin <= cut group by g, start))"
    source = f"(select *, {cov} from {source}, fl)"
    for i in range(P):
        for j in range(i + 1):
            v = f"c{i}{j}" + "".join(f" - l{i}{m} * l{j}{m}" for m in range(j))
            source = f"(select *, {f'sqrt(greatest({v}, 1e-12))' if i == j else f'({v}) / l{j}{j}'} as l{i}{j} from {source})"
    return f"est{k + 1} as materialized (select g, start, {', '.join(ESTIMATE)} from {source}),\n"


def oracle() -> str:
    long = " union all ".join(f"select g, {i} as i, cast(floor(x{i} / 20.0) as bigint) as bin from f" for i in range(P))
    pick = lambda value, name: ", ".join(f"max(case when i = {i} then {value} end)::double as {name}{i}" for i in range(P))
    cuts = " join ".join(f"(select g, i, cut as {name} from {cut_of('long', 'g, i', q)}){' using (g, i)' if name != 'low' else ''}" for q, name in ((0.25, "low"), (0.5, "mid"), (0.75, "high")))
    flat = ", ".join(f"sqrt(f{i} * f{i} + start * w{i} * w{i}) as l{i}{j}" if i == j else f"0.0::double as l{i}{j}" for i in range(P) for j in range(i + 1))
    sql = "with " + COUNTS + vector() + groups() + floors() + f"long as ({long}),\nwide as (select g, {pick(f'(mid * 20 + 10) / {float(UNIT)!r}', 'm')}, {pick(f'(high - low) * 20 / {1.349 * UNIT!r}', 'w')} from {cuts} group by g),\n"
    sql += f"est0 as materialized (select g, start, {', '.join(f'm{i}' for i in range(P))}, {flat} from wide, fl, (select unnest([0, 1]) as start)),\n"
    for k in range(STEPS):
        sql += distance(f"est{k}", f"dist{k}") + f"near{k} as materialized (select * exclude ({', '.join(ESTIMATE)}), cast(floor(ln(d2 + 1) * 64) as bigint) as bin from dist{k}),\n" + moments(k)
    det = "2 * ln(l00)" + "".join(f" + 2 * ln(l{i}{i})" for i in range(1, P))
    sql += f"best as (select * exclude (start, k) from (select *, row_number() over (partition by g order by round({det}, 9), start) as k from est{STEPS}) where k = 1),\n" + distance("best", "last")
    wanted = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
    return sql + f"done as (select 1) select {wanted}, round(d2, 9) as d2, d2 <= {CUT!r} as kept from last union all select {wanted}, null, false from v where base_failed"
