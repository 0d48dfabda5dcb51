"""Chart patterns in DuckDB SQL: the ten shapes, their breakouts, statistics and signals. Tables follow a table `bars`."""

from __future__ import annotations

from ..operators.chart import AHEAD, FLAGS, FLAT, NAMES, SCALES, STEP
from . import signal_sql as X

TYPICAL = "coalesce(greatest(300 * median(atr / nullif(close, 0)), 0.5), 3.0) / 100"


def swings(percent: float | None = None) -> str:
    """Tables up to `sw`, with the threshold of the whole series or a given one."""
    return X.SWINGS if percent is None else X.SWINGS.replace(TYPICAL, f"{percent / 100!r}::double")


def turned() -> str:
    """Candidates `ca` of head and shoulders and double tops, and their mirrors: a line is to be broken after bar `at`."""
    leads = ", ".join(f"lead({c}, {k}) over s as {n}{k}" for k in range(5) for c, n in (("price", "p"), ("ts", "t"), ("bar_idx", "i")))
    out = []
    for side, kind, direction, five, three in ((1, "high", "bearish", NAMES[0], NAMES[2]), (-1, "low", "bullish", NAMES[1], NAMES[3])):
        p = [f"({side} * p{k})" for k in range(5)]
        height, uneven, above = f"({p[2]} - least({p[1]}, {p[3]}))", f"abs({p[0]} - {p[4]})", f"({p[2]} - greatest({p[0]}, {p[4]}))"
        out.append(f"""select symbol, '{five}' as name, '{direction}' as direction, i4 as at_, t1 as x1, p1 as y1, t3 as x2, p3 as y2, round_even(100 * (0.5 * greatest(0, 1 - {uneven} / (0.5 * {height})) + 0.5 * least(1, {above} / {height} / 0.3)), 1) as confidence,
 swing_no as seq, 5 as n_vertices, least(p0, p1, p2, p3, p4) as vl, greatest(p0, p1, p2, p3, p4) as vh from q5 where i4 is not null and kind = '{kind}' and {above} > 0 and {height} > 0 and {uneven} <= 0.5 * {height} and {above} >= 0.1 * {height}""")
        height, uneven = f"({p[0]} - {p[1]})", f"abs({p[0]} - {p[2]})"
        out.append(f"""select symbol, '{three}', '{direction}', i2, t1, p1, t2, p1, round_even(100 * greatest(0, 1 - {uneven} / (0.15 * {height})), 1), swing_no, 3, least(p0, p1, p2), greatest(p0, p1, p2)
 from q5 where i2 is not null and kind = '{kind}' and {height} > 0 and {uneven} <= 0.15 * {height}""")
    return f"q5 as (select symbol, swing_no, kind, {leads} from sw window s as (partition by symbol order by swing_no)), ca as ({' union all '.join(out)})"


def narrowing() -> str:
    """Candidates `cb` of triangles and wedges, one for either line."""
    fits = ", ".join(f"{f}(price, bar_idx::double) filter (where kind = '{k}') as {k[0]}{n}" for k in ("high", "low") for f, n in (("regr_slope", "s"), ("regr_intercept", "i")))
    at = lambda s, k: f"({s}s * {k} + {s}i)"
    line = lambda d, s: f"""select symbol, name, '{d}' as direction, last_ as at_, tf as x1, {at(s, 'first_')} as y1, tl as x2, {at(s, 'last_')} as y2, round_even(100 * least(1, (g0 - g1) / g0), 1) as confidence,
 len::bigint * 10000000 + last_ as seq, n_vertices, vl, vh from w4"""  # noqa: E731
    return f"""w0 as (select symbol, count(*) as many, avg(close) as mean from bars group by 1 having avg(close) > 0), w1 as (select symbol, mean, len, unnest(range(len, many, {STEP})) as end_ from w0 join (select unnest({list(SCALES)!r}) as len) on many > len),
w2 as (select w.symbol, w.mean, w.len, w.end_ - w.len as first_, w.end_ - 1 as last_, count(*) filter (where kind = 'high') as nh, count(*) filter (where kind = 'low') as nl, count(*) as n_vertices, min(price) as vl, max(price) as vh, {fits}
 from w1 w join sw on sw.symbol = w.symbol and bar_idx between w.end_ - w.len and w.end_ - 1 group by 1, 2, 3, 4, 5),
w3 as (select *, hs / mean as h, ls / mean as l, {at('h', 'first_')} - {at('l', 'first_')} as g0, {at('h', 'last_')} - {at('l', 'last_')} as g1 from w2 where nh >= 2 and nl >= 2),
w4 as (select w3.*, a.ts as tf, b.ts as tl, case when abs(h) < {FLAT} and l > {FLAT} then 'ascending_triangle' when abs(l) < {FLAT} and h < -{FLAT} then 'descending_triangle' when h < -{FLAT} and l > {FLAT} then 'symmetrical_triangle'
 when h > {FLAT} and l > {FLAT} and h < l then 'rising_wedge' when h < -{FLAT} and l < -{FLAT} and h < l then 'falling_wedge' end as name from w3 join n a on a.symbol = w3.symbol and a.rn = first_ + 1 join n b on b.symbol = w3.symbol and b.rn = last_ + 1
 where g0 > 0 and g1 > 0 and g1 < g0 * 0.9), cb as (select * from ({line('bullish', 'h')} union all {line('bearish', 'l')}) where name is not null)"""


def poles() -> str:
    """Candidates `cc` of flags, with the number of the pole's length as `k`."""
    out = []
    for k, (pole, channel) in enumerate(FLAGS):
        out.append(f"""select symbol, 'flag' as name, case when pct > 0 then 'bullish' else 'bearish' end as direction, i + {channel - 1} as at_, ts as x1, level as y1, te as x2, level as y2,
 round_even(100 * (0.5 * greatest(0, 1 - size / (abs(pct) * 0.5 + 1e-9)) + 0.5 * least(1, abs(pct) / 15.0)), 1) as confidence, i + {k * 1_000_000_000} as seq, 3 as n_vertices, least(p0, close, level) as vl, greatest(p0, close, level) as vh, {k} as k, {channel} as channel from (
 select *, case when pct > 0 then hi else lo end as level from (select *, (close / p0 - 1) * 100 as pct, coalesce((hi - lo) / nullif(m, 0) * 100, 999) as size from (
 select symbol, ts, close, rn - 1 as i, count(*) over (partition by symbol) as many, lag(close, {pole}) over ({X.W}) as p0, lead(ts, {channel - 1}) over ({X.W}) as te, max(high) over f as hi, min(low) over f as lo, avg(close) over f as m from n
 window f as ({X.W} rows between current row and {channel - 1} following)) where i >= {pole} and i < many - {channel} - 1 and p0 > 0)) where abs(pct) >= 5 and size <= abs(pct) * 0.5""")
    return f"cc as ({' union all '.join(out)})"


def broken(name: str, source: str, more: str = "") -> str:
    """Table `name` of the candidates of `source` with the first of the next closes beyond their line."""
    line = "case when epoch_us(x2) = epoch_us(x1) then y2 else y1 + (epoch_us(b.ts) - epoch_us(x1)) / (epoch_us(x2) - epoch_us(x1)) * (y2 - y1) end"
    own = f"c.symbol, c.name, c.direction, c.at_, c.confidence, c.seq, c.n_vertices, c.vl, c.vh{more}"
    return f"""{name} as (select {own}, min(b.rn) - 1 as breakout_idx, arg_min(b.ts, b.rn) as breakout_time, arg_min(b.close, b.rn) as breakout_price from {source} c join n b on b.symbol = c.symbol and b.rn - 1 between c.at_ + 1 and c.at_ + {AHEAD}
 where case c.direction when 'bullish' then b.close > {line} else b.close < {line} end group by all)"""


def patterns(percent: float | None = None) -> str:
    """Tables up to `ch`: every occurrence, as chart.chart_patterns() has them."""
    columns = "symbol, name, direction, at_, confidence, seq, n_vertices, vl, vh, breakout_idx, breakout_time, breakout_price"
    return f"""{swings(percent)}, {turned()}, {narrowing()}, {poles()}, {broken('ba', 'ca')}, {broken('bb_', 'cb')}, {broken('bc', 'cc', ', c.k, c.channel')},
bn as (select * from (select *, row_number() over (partition by symbol, name, seq order by breakout_idx, direction desc) as one from bb_) where one = 1),
fk as (select symbol, k, channel, min(at_) as at_ from bc group by 1, 2, 3 union all select f.symbol, f.k, f.channel, (select min(bc.at_) from bc where bc.symbol = f.symbol and bc.k = f.k and bc.at_ >= f.at_ + f.channel) from fk f where f.at_ is not null),
bf as (select bc.* from bc join fk on fk.symbol = bc.symbol and fk.k = bc.k and fk.at_ = bc.at_),
ch as (select *, row_number() over (partition by symbol order by list_position({list(NAMES)!r}, name), seq, at_) as place from (select {columns} from ba union all select {columns} from bn union all select {columns} from bf))"""


def stats(ahead: int = 10) -> str:
    """Table `cs` from `ch`: statistics of each shape."""
    return f"""cr as (select symbol, rn - 1 as breakout_idx, lead(close, {ahead}) over ({X.W}) / nullif(close, 0) - 1 as fr from n), co as (select ch.*, fr from ch join cr using (symbol, breakout_idx) where fr is not null),
cg as (select symbol, name, case when 2 * count(*) filter (where direction = 'bullish') >= count(*) then 'bullish' else 'bearish' end as direction, count(*) as occurrences, avg(cast(case direction when 'bullish' then fr > 0 else fr < 0 end as double)) as win_rate,
 avg(fr) as avg_forward_return, avg(confidence) as avg_confidence from co group by 1, 2), cs as (select s.symbol, s.name, cg.direction, coalesce(occurrences, 0) as occurrences, win_rate, avg_forward_return, avg_confidence
 from (select * from (select distinct symbol from bars), (select unnest({list(NAMES)!r}) as name)) s left join cg on cg.symbol = s.symbol and cg.name = s.name)"""


def signals(mode: str = "level_reversal", hold: int = 30) -> str:
    """Tables from `ch` to `sg`: the bars with signal, stop_price and target_price."""
    up = "case direction when 'bullish' then {} else {} end"
    stop = f"arg_max({up.format('vl', 'vh')}, place)" if mode == "vertex_stop" else "cast(null as double)"
    target = f"arg_max(breakout_price + {up.format(1, -1)} * (vh - vl), place)" if mode == "measured_move" else "cast(null as double)"
    return f"""s0 as (select ch.symbol, place, direction, n.rn - 1 as i, min({up.format('n.close >= breakout_price', 'n.close <= breakout_price')}::int) over (partition by ch.symbol, place order by n.rn rows unbounded preceding) as ok
 from ch join n on n.symbol = ch.symbol and n.rn - 1 between breakout_idx and breakout_idx + {hold}), s1 as (select symbol, i, arg_max({up.format(1, -1)}, place) as signal from s0 where ok = 1 group by 1, 2),
s2 as (select symbol, breakout_idx as i, {stop} as stop_price, {target} as target_price from ch group by 1, 2), sg as (select n.symbol, n.ts, open, high, low, close, volume, coalesce(signal, 0) as signal, stop_price, target_price
 from n left join s1 on s1.symbol = n.symbol and s1.i = n.rn - 1 left join s2 on s2.symbol = n.symbol and s2.i = n.rn - 1)"""
