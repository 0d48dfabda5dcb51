"""DuckDB SQL of indicators with a memory, of every strategy's signals in every exit mode, and of back-tests on them.

Tables are common table expressions; `{W}` orders a symbol's bars. A recurrence is a recursive one over numbered bars.
"""

from __future__ import annotations

W = "partition by symbol order by ts"
DAY = "partition by symbol, cast(ts as date) order by ts"


def frame(n: int, end: str = "current row") -> str:
    return f"({W} rows between {n - 1 if end == 'current row' else n} preceding and {end})"


def guarded(expr: str, n: int, of: str = "close", end: str = "current row") -> str:
    """A rolling aggregate that needs n values; {w} stands for its frame."""
    over = f"over {frame(n, end)}"
    return f"case when count({of}) {over} >= {n} then {expr.format(w=over)} end"


NUMBERED = f"n as (select *, cast(ts as date) as d, row_number() over ({W}) as rn, row_number() over ({DAY}) as dn from bars)"


def recurrence(name: str, source: str, first: str, step: str, number: str = "rn", also: str = "") -> str:
    """Table `name` of (symbol, ts, number, first's columns): `step` from r, the row before, and n, a row of `source`."""
    return (
        f"{name} as (select symbol, ts, {number}{also}, {first} from {source} where {number} = 1 union all select n.symbol, n.ts, n.{number}{', n.d' if also else ''}, {step} "
        f"from {name} r join {source} n on n.symbol = r.symbol and n.{number} = r.{number} + 1{' and n.d = r.d' if also else ''})"
    )


MOVES = f"""c0 as (select *, lag(close) over ({W}) as pc, high - lag(high) over ({W}) as up, lag(low) over ({W}) - low as down from n),
c as (select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr, case when up > down and up > 0 then up else 0.0 end as pu, case when down > up and down > 0 then down else 0.0 end as pd, coalesce(close - pc, 0) as ch from c0)"""
SMOOTH = recurrence(
    "sm", "c", "tr as t, cast(pu as double) as p, cast(pd as double) as m, cast(null as double) as g, cast(null as double) as l",
    "r.t * 13 / 14 + n.tr / 14, r.p * 13 / 14 + n.pu / 14, r.m * 13 / 14 + n.pd / 14, coalesce(r.g * 13 / 14 + greatest(n.ch, 0) / 14, greatest(n.ch, 0)), coalesce(r.l * 13 / 14 + greatest(-n.ch, 0) / 14, greatest(-n.ch, 0))",
)
DX = "dx as (select *, case when rn >= 14 then 100 * abs(100 * p / nullif(t, 0) - 100 * m / nullif(t, 0)) / nullif(100 * p / nullif(t, 0) + 100 * m / nullif(t, 0), 0) end as x from sm)"
ADX = recurrence("ax", "dx", "cast(x as double) as y", "coalesce(r.y * 13 / 14 + n.x / 14, n.x)")
#: rsi, atr and adx of each bar
STRENGTH = f"{NUMBERED}, {MOVES}, {SMOOTH}, {DX}, {ADX}, st as (select sm.symbol, sm.ts, case when sm.rn > 14 and l <> 0 then 100 - 100 / (1 + g / l) else 50 end as rsi, case when sm.rn >= 14 then t end as atr, case when sm.rn >= 27 then coalesce(y, 0) else 0 end as adx from sm join ax on ax.symbol = sm.symbol and ax.rn = sm.rn)"
_BEHIND, _AHEAD = "case when r.side > 0 then n.low else -n.high end", "case when r.side > 0 then n.high else -n.low end"
_NEXT = "least(r.sar + r.speed * (r.ext - r.sar), case when r.side > 0 then n.low1 else -n.high1 end, case when r.side > 0 then n.low2 else -n.high2 end)"
SAR = (
    f"s0 as (select *, lag(low) over ({W}) as low1, lag(low, 2) over ({W}) as low2, lag(high) over ({W}) as high1, lag(high, 2) over ({W}) as high2, lead(high) over ({W}) as nh, count(*) over (partition by symbol) as many from n), "
    + recurrence(
        "sa", "s0", "case when nh >= high then 1 else -1 end as side, case when nh >= high then low else -high end as sar, case when nh >= high then high else -low end as ext, cast(0.02 as double) as speed",
        f"case when {_BEHIND} < {_NEXT} then -r.side else r.side end, case when {_BEHIND} < {_NEXT} then -r.ext else {_NEXT} end, case when {_BEHIND} < {_NEXT} then -({_BEHIND}) else greatest(r.ext, {_AHEAD}) end, "
        f"case when {_BEHIND} < {_NEXT} then 0.02 when {_AHEAD} > r.ext then least(r.speed + 0.02, 0.2) else r.speed end",
    )
    + ", sr as (select sa.symbol, sa.ts, case when many >= 2 then side * sar end as sar from sa join s0 on s0.symbol = sa.symbol and s0.rn = sa.rn)"
)
MACD = recurrence("mc", "n", "close as f, close as s, cast(0 as double) as g", "r.f * 11 / 13 + n.close * 2 / 13, r.s * 25 / 27 + n.close * 2 / 27, r.g * 0.8 + ((r.f * 11 / 13 + n.close * 2 / 13) - (r.s * 25 / 27 + n.close * 2 / 27)) * 0.2")
HEIKIN = recurrence("ha", "n", "open as o, (open + high + low + close) / 4 as c, high as h, low as l", "(r.o + r.c) / 2, (n.open + n.high + n.low + n.close) / 4, n.high, n.low")
SESSION_EMA = recurrence("se", "n", "close as f, close as s", "r.f * 0.8 + n.close * 0.2, r.s * 19 / 21 + n.close * 2 / 21", "dn", ", d")
VWAP = f"v as (select *, sum((high + low + close) / 3 * volume) over ({DAY} rows unbounded preceding) / nullif(sum(volume) over ({DAY} rows unbounded preceding), 0) as vwap from bars)"
BANDS = f"bb as (select *, {guarded('avg(close) {w}', 20)} as mid, {guarded('stddev_samp(close) {w}', 20)} as sd from bars)"
CHANNEL = f"ch as (select *, {guarded('max(high) {w}', 20, 'high', '1 preceding')} as ph, {guarded('min(low) {w}', 20, 'low', '1 preceding')} as pl, {guarded('avg(volume) {w}', 20, 'volume', '1 preceding')} as av from bars)"
AWESOME = f"a0 as (select *, (high + low) / 2 as m from bars), aw as (select *, ({guarded('avg(m) {w}', 5, 'm')}) - ({guarded('avg(m) {w}', 34, 'm')}) as ao, min(low) over ({W} rows between 10 preceding and 1 preceding) as sl, max(high) over ({W} rows between 10 preceding and 1 preceding) as sh from a0)"
COIL = f"""k0 as (select *, {guarded('avg(high - low) {w}', 20)} as r from bars), k1 as (select *, quantile_cont(r, 0.2) over ({W} rows unbounded preceding) as q, count(r) over ({W} rows unbounded preceding) as many from k0),
k2 as (select *, coalesce(r <= q and many >= 20, false) as contraction from k1)"""
THRUST = """t0 as (select symbol, cast(ts as date) as d, arg_min(open, ts) as o, max(high) as h, min(low) as l, arg_max(close, ts) as c from bars group by 1, 2),
t1 as (select *, count(*) over w as k, max(h) over w - min(c) over w as x, max(c) over w - min(l) over w as y from t0 window w as (partition by symbol order by d rows between 4 preceding and 1 preceding)),
th as (select b.*, case when k >= 4 then greatest(x, y) end as size, o + 0.5 * case when k >= 4 then greatest(x, y) end as buy, o - 0.5 * case when k >= 4 then greatest(x, y) end as sell from bars b join t1 on t1.symbol = b.symbol and t1.d = cast(b.ts as date))"""


def strategy_tables(candles: str, bullish: str, bearish: str) -> dict[str, tuple[str, str, str, str, dict]]:
    """name: (tables, the last of them, long, short, {mode: (kind, what it needs, stop, target)}); stops and targets are pairs
    for long and short entries, or one for every bar."""
    move = lambda hi, lo, size: (f"{hi} + ({size})", f"{lo} - ({size})")
    middle = "(oh + ol) / 2"
    return {
        "orb": (f"{NUMBERED}, q as (select *, max(case when dn <= 1 then high end) over (partition by symbol, d) as oh, min(case when dn <= 1 then low end) over (partition by symbol, d) as ol from n)", "q", "close > oh", "close < ol", {
            "level_reversal": ("level", None, None, None), "or_midpoint": ("hold", (f"close <= {middle}", f"close >= {middle}"), None, None), "measured_move": ("level", None, None, move("oh", "ol", "oh - ol")),
        }),
        "vwap_reversion": (f"{VWAP}, w0 as (select *, close - vwap as dev from v), w1 as (select *, {guarded('stddev_samp(dev) {w}', 30, 'dev')} as sd from w0)", "w1", "dev < -sd", "dev > sd", {
            "threshold_cross": ("level", None, None, None), "midline": ("hold", ("dev >= 0", "dev <= 0"), None, None), "opposite_extreme": ("hold", ("dev > sd", "dev < -sd"), None, None),
        }),
        "ma_crossover": (f"{NUMBERED}, {SESSION_EMA}, q as (select n.*, f, s from n join se on se.symbol = n.symbol and se.ts = n.ts)", "q", "f - s > 0", "f - s < 0", {
            "signal_reversal": ("level", None, None, None), "confirmed_reversal": ("confirmed", (3, True), None, None), "slow_ema_stop": ("level", None, "s", None),
        }),
        "rsi_reversion": (f"{STRENGTH}, q as (select bars.*, rsi from bars join st using (symbol, ts))", "q", "rsi < 30", "rsi > 70", {
            "threshold_cross": ("level", None, None, None), "midline": ("hold", ("rsi >= 50", "rsi <= 50"), None, None), "opposite_extreme": ("hold", ("rsi >= 70", "rsi <= 30"), None, None),
        }),
        "volume_momentum": (CHANNEL, "ch", "close > ph and volume > 2 * av", "close < pl and volume > 2 * av", {
            "level_reversal": ("level", None, None, None), "swing_stop": ("level", None, ("pl", "ph"), None), "measured_move": ("level", None, None, move("ph", "pl", "ph - pl")),
        }),
        "candlestick_reversal": (candles, "k", bullish, bearish, {
            "opposite_pattern": ("level", None, None, None), "fixed_hold": ("fixed", 5, None, None),
            "candle_stop": ("level", None, ("low", "high"), ("close + 1.5 * (close - low)", "close - 1.5 * (high - close)")),
        }),
        "range_breakout": (f"{COIL}, {CHANNEL}, q as (select ch.*, coalesce(lag(contraction) over (partition by ch.symbol order by ch.ts), false) as coiled from ch join k2 using (symbol, ts))", "q", "coiled and close > ph", "coiled and close < pl", {
            "level_reversal": ("level", None, None, None), "contraction_stop": ("level", None, ("pl", "ph"), None), "measured_move": ("level", None, None, move("ph", "pl", "ph - pl")),
        }),
        "awesome_oscillator": (AWESOME, "aw", "ao > 0", "ao < 0", {
            "zero_cross": ("level", None, None, None), "confirmed_reversal": ("confirmed", (3, False), None, None), "swing_stop": ("level", None, ("sl", "sh"), None),
        }),
        "macd_crossover": (f"{NUMBERED}, {MACD}, m0 as (select n.*, f - s as line, g as sig, f - s - g as hist from n join mc on mc.symbol = n.symbol and mc.rn = n.rn), q as (select *, line > sig and not coalesce(lag(line > sig) over ({W}), false) as cu, line < sig and not coalesce(lag(line < sig) over ({W}), false) as cd, hist - lag(hist) over ({W}) as dh from m0)", "q", "line > sig", "line < sig", {
            "signal_reversal": ("level", None, None, None), "histogram_fade": ("hold", ("dh < 0", "dh > 0", "cu", "cd"), None, None), "zero_cross": ("hold", ("line <= 0", "line >= 0", "cu", "cd"), None, None),
        }),
        "parabolic_sar": (f"{NUMBERED}, {SAR}, q as (select bars.*, sar from bars join sr using (symbol, ts))", "q", "close - sar > 0", "close - sar < 0", {
            "sar_flip": ("level", None, None, None), "confirmed_flip": ("confirmed", (2, False), None, None), "sar_bracket": ("level", None, "sar", None),
        }),
        "dual_thrust": (THRUST, "th", "close > buy", "close < sell", {
            "level_reversal": ("level", None, None, None), "session_close_only": ("hold", ("false", "false", None, None, True), None, None), "measured_move": ("level", None, None, move("buy", "sell", "size")),
        }),
        "heikin_ashi_trend": (f"{NUMBERED}, {HEIKIN}, q as (select n.*, o as ho, c as hc, greatest(o, c, h) as hh, least(o, c, l) as hl from n join ha on ha.symbol = n.symbol and ha.rn = n.rn)", "q",
                              "hh <> hl and hc > ho and ho - hl <= 0.05 * (hh - hl)", "hh <> hl and hc < ho and hh - ho <= 0.05 * (hh - hl)", {
            "shaven_candle": ("level", None, None, None), "any_reversal": ("hold", ("hc < ho", "hc > ho"), None, None), "entry_candle_stop": ("level", None, ("hl", "hh"), None),
        }),
        "bollinger_reversion": (BANDS, "bb", "close <= mid - 2 * sd", "close >= mid + 2 * sd", {
            "threshold_cross": ("level", None, None, None), "midline": ("hold", ("close >= mid", "close <= mid"), None, None), "opposite_extreme": ("hold", ("close >= mid + 2 * sd", "close <= mid - 2 * sd"), None, None),
        }),
    }


def price(of) -> str:
    if of is None:
        return "cast(null as double)"
    return f"case when es then {of[1]} when el then {of[0]} end" if isinstance(of, tuple) else of


def signals(tables: str, last: str, long: str, short: str, kind: str, needs, stop, target) -> str:
    """Tables up to `sg`: the bars with signal, stop_price and target_price."""
    enter = "case when el then 1 when es then -1 else 0 end"
    session = kind == "confirmed" and needs[1] or kind == "hold" and len(needs) > 4
    by = "symbol, cast(ts as date)" if session else "symbol"
    e1 = f"e1 as (select *, coalesce({long}, false) as el, coalesce({short}, false) as es from {last}), e2 as (select *, {price(stop)} as stop_price, {price(target)} as target_price, cast(ts as date) as sd_, row_number() over (partition by {by} order by ts) as i_ from e1)"
    where = "n.symbol = r.symbol and n.i_ = r.i_ + 1" + (" and n.sd_ = r.sd_" if session else "")
    out = "symbol, ts, open, high, low, close, volume"
    wanted = ", ".join(f"e.{c.strip()}" for c in (*out.split(","), "stop_price", "target_price"))
    if kind == "level":
        return f"{tables}, {e1}, sg as (select {out}, case when es then -1 when el then 1 else 0 end as signal, stop_price, target_price from e2)"
    if kind == "hold":
        into = (needs[2], needs[3]) if len(needs) > 3 and needs[2] else ("el", "es")
        e3 = f"e3 as (select *, {into[0]} as il, {into[1]} as is_, coalesce({needs[0]}, false) as xl, coalesce({needs[1]}, false) as xs from e2)"
        begin = lambda t: f"case when {t}il then 1 when {t}is_ then -1 else 0 end"
        walk = f"hd as (select symbol, ts, sd_, i_, {begin('')} as s from e3 where i_ = 1 union all select n.symbol, n.ts, n.sd_, n.i_, case when r.s = 0 or (r.s > 0 and n.xl) or (r.s < 0 and n.xs) then {begin('n.')} else r.s end from hd r join e3 n on {where})"
        return f"{tables}, {e1}, {e3}, {walk}, sg as (select {wanted}, hd.s as signal from e3 e join hd on hd.symbol = e.symbol and hd.ts = e.ts)"
    if kind == "fixed":
        ends = f"(r.s <> 0 and (n.i_ > r.until or case when r.s > 0 then n.es else n.el end))"  # noqa: F541
        fresh = f"(r.s = 0 or {ends})"
        n_enter = enter.replace("el", "n.el").replace("n.else", "else").replace("es then", "n.es then")
        walk = f"hd as (select symbol, ts, i_, {enter} as s, cast(i_ + {needs} - 1 as bigint) as until from e2 where i_ = 1 union all select n.symbol, n.ts, n.i_, case when {fresh} then {n_enter} else r.s end, case when {fresh} then cast(n.i_ + {needs} - 1 as bigint) else r.until end from hd r join e2 n on {where})"
        return f"{tables}, {e1}, {walk}, sg as (select {wanted}, hd.s as signal from e2 e join hd on hd.symbol = e.symbol and hd.ts = e.ts)"
    confirm = needs[0]
    raw = f"""f0 as (select *, case when es then -1 when el then 1 else 0 end as raw from e2), f1 as (select *, i_ - row_number() over (partition by {by}, raw order by ts) as g from f0),
f2 as (select *, row_number() over (partition by {by}, raw, g order by ts) as len from f1)"""
    return f"{tables}, {e1}, {raw}, sg as (select {out}, coalesce(last_value(case when len >= {confirm} then raw end ignore nulls) over (partition by {by} order by ts rows unbounded preceding), 0) as signal, stop_price, target_price from f2)"


def account(later: bool = True, commission: float = 0.0, flatten: bool = True) -> str:
    """Tables from `sg` to `tr` (runs with their size and profit) and `eq` (equity by bar)."""
    flat = f"case when row_number() over (partition by symbol, cast(ts as date) order by ts desc) <= 1 and count(*) over (partition by symbol, cast(ts as date)) > 1 then 0 else signal end" if flatten else "signal"  # noqa: F541
    held = f"coalesce(lag(flat) over ({W}), 0)" if later else "flat"
    fill = "open" if later else "close"
    return f"""b0 as (select *, {flat} as flat from sg), b1 as (select *, {held} as position, {fill} as fill, row_number() over ({W}) - 1 as i from b0),
b2 as (select *, case when i = 0 or position is distinct from lag(position) over ({W}) then 1 else 0 end as nw, lead(fill) over ({W}) as nf, lead(ts) over ({W}) as nts from b1), b3 as (select *, sum(nw) over ({W} rows unbounded preceding) as run from b2),
b4 as (select *, first_value(stop_price) over (partition by symbol, run order by ts) as st, first_value(target_price) over (partition by symbol, run order by ts) as tg from b3),
b5 as (select *, coalesce(case when position > 0 then low <= st else high >= st end, false) as hs, coalesce(case when position > 0 then high >= tg else low <= tg end, false) as ht from b4 where position <> 0),
b6 as (select *, case when ht and (not hs or position > 0) then tg when hs then st end as level from b5),
z as (select symbol, run, any_value(position) as side, min(ts) as t0, arg_min(fill, i) as o, min(i) filter (where level is not null) as hit, arg_min(level, i) filter (where level is not null) as hp, arg_min(ts, i) filter (where level is not null) as hts, arg_max({{'v': nf}}, i)['v'] as nx, arg_max(close, i) as lc, arg_max(coalesce(nts, ts), i) as lt from b6 group by 1, 2),
y as (select *, o * (1 + 0.0001 * side) as ep, coalesce(hp * (1 - 0.0001 * side), nx * (1 - 0.0001 * side), lc) as xp, coalesce(hts, lt) as t1, row_number() over (partition by symbol order by run) as k from z),
tr as (select symbol, k, run, side, ep, xp, t0, t1, hit, cast(100000 as double) as capital, floor(100000 / ep) as qty, floor(100000 / ep) * side * (xp - ep) - {2 * commission} as pnl, greatest(-100000, floor(100000 / ep) * side * (xp - ep) - {2 * commission}) as realised from y where k = 1
 union all select y.symbol, y.k, y.run, y.side, y.ep, y.xp, y.t0, y.t1, y.hit, 100000 + r.realised, greatest(0, floor((100000 + r.realised) / y.ep)), case when greatest(0, floor((100000 + r.realised) / y.ep)) > 0 then floor((100000 + r.realised) / y.ep) * y.side * (y.xp - y.ep) - {2 * commission} else 0 end,
 case when greatest(0, floor((100000 + r.realised) / y.ep)) > 0 then greatest(-100000, r.realised + floor((100000 + r.realised) / y.ep) * y.side * (y.xp - y.ep) - {2 * commission}) else r.realised end from tr r join y on y.symbol = r.symbol and y.k = r.k + 1),
eq as (select u.symbol, u.ts, u.i, u.position, u.close, case when u.position = 0 then 100000 + coalesce(last_value(tr.realised ignore nulls) over (partition by u.symbol order by u.ts rows unbounded preceding), 0) when tr.qty <= 0 then tr.capital
 when u.i > tr.hit then 100000 + tr.realised else greatest(0, tr.capital - {commission} + tr.qty * u.position * (u.close - tr.ep)) end as equity from b3 u left join tr on tr.symbol = u.symbol and tr.run = u.run)"""


METRICS = f"""h0 as (select *, equity / nullif(lag(equity) over ({W}), 0) - 1 as r, max(equity) over ({W} rows unbounded preceding) as peak from eq),
h1 as (select symbol, count(*) as n, count(distinct cast(ts as date)) as days, arg_max(equity, i) as last, avg(r) as mean, count(r) as nr, stddev_samp(r) as sd, stddev_samp(r) filter (where r < 0) as dsd, min((equity - peak) / nullif(peak, 0)) as max_drawdown from h0 group by 1),
h2 as (select *, last / 100000 - 1 as total_return, sqrt(n / days * 252) as f from h1),
h3 as (select symbol, count(*) as num_trades, count(*) filter (where pnl > 0) / count(*) as win_rate, coalesce(sum(pnl) filter (where pnl > 0), 0) / nullif(abs(coalesce(sum(pnl) filter (where pnl < 0), 0)), 0) as profit_factor, avg(pnl / (qty * ep)) as avg_trade_return_pct from tr where qty > 0 group by 1),
mt as (select symbol, round(total_return, 6) as total_return, round(case when 1 + total_return > 0 then pow(1 + total_return, 252 / days) - 1 end, 6) as annualized_return, round(case when nr >= 2 then mean / nullif(sd, 0) * f end, 6) as sharpe_ratio, round(case when nr >= 2 then mean / nullif(dsd, 0) * f end, 6) as sortino_ratio,
 round(max_drawdown, 6) as max_drawdown, round(win_rate, 6) as win_rate, round(profit_factor, 6) as profit_factor, coalesce(num_trades, 0) as num_trades, round(avg_trade_return_pct, 6) as avg_trade_return_pct from h2 left join h3 using (symbol))"""
#: The same with the Sharpe ratio before it is rounded, for ranks and means.
EXACT_METRICS = METRICS.replace("mt as (select symbol,", "mt as (select symbol, case when nr >= 2 then mean / nullif(sd, 0) * f end as exact,")
BAR = "ts, open, high, low, close, volume"


def contest(tables: dict[str, tuple | str], names: list[str], bars: str) -> str:
    """Tables up to `mt`: figures of strategies in their default modes, each on all `bars`; its symbol is symbol#strategy. A
    strategy's tables (parts of them for signals(), or all of them as one text) are a query of its own, as their names are alike."""
    made = {n: t if isinstance(t, str) else signals(*t[:4], *next(iter(t[4].values()))) for n, t in tables.items() if n in names}
    each = " union all ".join(
        f"(with recursive {bars}, {made[n]} select symbol || '#{n}' as symbol, {BAR}, signal, cast(stop_price as double) as stop_price, cast(target_price as double) as target_price from sg)"
        for n in names
    )
    return f"every as materialized ({each}), sg as (select * from every), {account()}, {EXACT_METRICS}"


def benchmark(bars: str) -> str:
    """Figures of the bars held over night, as rows of `mt`."""
    held = f"sg as (select symbol || '#buy_and_hold' as symbol, {BAR}, 1 as signal, cast(null as double) as stop_price, cast(null as double) as target_price from bars)"
    return f"(with recursive {bars}, {held}, {account(flatten=False)}, {EXACT_METRICS} select * from mt)"


def order_of(names: list[str]) -> str:
    return f"list_position({names!r}, strategy)"


def walk(tables: dict[str, tuple | str], names: list[str], bars: str, regimes: str, before: int, test: int) -> str:
    """Tables up to `wf`: figures of each strategy on the test days of each fold, the fold's regime, and `won`."""
    raw = bars.replace("bars as", "raw as", 1)
    days = f"{raw}, dy as (select distinct symbol, cast(ts as date) as day from raw), {fold_table(before, test)}"
    tested = f"{days}, bars as (select raw.symbol || '@' || fold_id as symbol, {BAR} from raw join fo on fo.symbol = raw.symbol and fo.day = cast(raw.ts as date) and part = 'test')"
    at = f"""ar as (select r.symbol, fold_id, arg_max(trend_regime, ts) as trend_regime, arg_max(vol_regime, ts) as vol_regime from (with recursive {bars}, {regimes} select * from re) r
 join (with recursive {days} select * from fo) f on f.symbol = r.symbol and f.day = cast(r.ts as date) and part = 'before' group by 1, 2)"""
    return f"""{contest(tables, names, tested)}, {at}, wn as (select * exclude (symbol), split_part(symbol, '@', 1) as symbol, cast(split_part(split_part(symbol, '@', 2), '#', 1) as int) as fold_id, split_part(symbol, '#', 2) as strategy from mt),
wf as (select wn.*, trend_regime, vol_regime, exact is not null and row_number() over (partition by symbol, fold_id order by exact desc nulls last, {order_of(names)}) = 1 as won from wn join ar using (symbol, fold_id))"""


def mapped(names: list[str]) -> str:
    """Table `rm`: strategies by regime, from `wf`."""
    return f"""r0 as (select symbol, trend_regime, vol_regime, strategy, count(*) filter (where won) as wins, count(*) as folds, avg(exact) as avg_metric from wf group by 1, 2, 3, 4),
rm as (select *, row_number() over (partition by symbol, trend_regime, vol_regime order by avg_metric desc nulls last, wins desc, {order_of(names)}) as place from r0)"""


EXTREMES = f"""x0 as (select *, max(equity) over ({W} rows unbounded preceding) as hi, min(equity) over ({W} rows unbounded preceding) as lo from eq), x1 as (select *, min(ts) over (partition by symbol, hi) as hts, min(ts) over (partition by symbol, lo) as lts from x0),
x2 as (select symbol, 'worst' as kind, hts as from_ts, ts as to_ts, equity - hi as change, (equity - hi) / nullif(hi, 0) as change_pct, hi - equity as size from x1 union all select symbol, 'best', lts, ts, equity - lo, (equity - lo) / nullif(lo, 0), equity - lo from x1),
ex as (select * from (select *, row_number() over (partition by symbol, kind order by size desc, to_ts) as k from x2) where k = 1 and size >= 1e-6)"""

SWINGS = f"""{STRENGTH}, g0 as (select symbol, coalesce(greatest(300 * median(atr / nullif(close, 0)), 0.5), 3.0) / 100 as pct, count(*) as many from bars join st using (symbol, ts) group by 1), g1 as (select n.*, pct from n join g0 using (symbol) where many >= 3),
zz as (select symbol, ts, rn, 0 as seek, rn as t, high as tp, rn as b, low as bp, cast(null as bigint) as found, cast(null as double) as price, cast(null as varchar) as kind, pct from g1 where rn = 1
 union all select symbol, ts, rn, case when turn = 1 then -1 when turn = -1 then 1 else seek end, case when turn = -1 then rn else t end, case when turn = -1 then high else tp end, case when turn = 1 then rn else b end, case when turn = 1 then low else bp end,
  case turn when 1 then t when -1 then b end, case turn when 1 then tp when -1 then bp end, case turn when 1 then 'high' when -1 then 'low' end, pct from (
  select *, case when down then 1 when seek <= 0 and not fresh_low and high >= bp0 * (1 + pct) then -1 else 0 end as turn from (
  select n.symbol, n.ts, n.rn, n.high, n.low, n.pct, r.seek, r.bp as bp0, r.seek >= 0 and n.high > r.tp as fresh_high, r.seek <= 0 and n.low < r.bp as fresh_low, r.seek >= 0 and n.high <= r.tp and n.low <= r.tp * (1 - n.pct) as down,
   case when r.seek >= 0 and n.high > r.tp then n.rn else r.t end as t, case when r.seek >= 0 and n.high > r.tp then n.high else r.tp end as tp, case when r.seek <= 0 and n.low < r.bp then n.rn else r.b end as b, case when r.seek <= 0 and n.low < r.bp then n.low else r.bp end as bp
  from zz r join g1 n on n.symbol = r.symbol and n.rn = r.rn + 1))),
g2 as (select symbol, found, price, kind from zz where found is not null union all select symbol, case when seek > 0 then t else b end, case when seek > 0 then tp else bp end, case when seek > 0 then 'high' else 'low' end from (select *, row_number() over (partition by symbol order by rn desc) as back from zz) where back = 1 and seek <> 0),
sw as (select g2.symbol, row_number() over (partition by g2.symbol order by found) - 1 as swing_no, found - 1 as bar_idx, n.ts, price, kind from g2 join n on n.symbol = g2.symbol and n.rn = g2.found)"""

INDICATORS = f"""{STRENGTH}, {SAR}, {MACD},
i0 as (select *, (high + low + close) / 3 as tp, (high + low) / 2 as hm, {guarded('avg(close) {w}', 20)} as mid, {guarded('stddev_samp(close) {w}', 20)} as sd, {guarded('min(low) {w}', 14, 'low')} as lo14, {guarded('max(high) {w}', 14, 'high')} as hi14,
 {guarded('avg(volume) {w}', 20, 'volume')} as av, avg(volume) over ({W} rows between 19 preceding and current row) as av1, coalesce(sign(close - lag(close) over ({W})), 0) * volume as ov, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume as cf from bars),
i1 as (select *, coalesce(tp > lag(tp) over ({W}), false) as up, sum(ov) over ({W} rows unbounded preceding) as obv, ({guarded('avg(hm) {w}', 5, 'hm')}) - ({guarded('avg(hm) {w}', 34, 'hm')}) as ao,
 coalesce(({guarded('sum(cf) {w}', 20, 'cf')}) / nullif({guarded('sum(volume) {w}', 20, 'volume')}, 0), 0) as cmf, 100 * (close - lo14) / nullif(hi14 - lo14, 0) as k from i0),
i2 as (select *, case when up then tp * volume else 0 end as fa, case when up then 0 else tp * volume end as fz, {guarded('avg(obv) {w}', 20, 'obv')} as obv20 from i1),
i3 as (select *, coalesce(100 - 100 / (1 + ({guarded('sum(fa) {w}', 14, 'fa')}) / nullif({guarded('sum(fz) {w}', 14, 'fz')}, 0)), 50) as mfi from i2),
ii as (select i3.*, rsi, atr, adx, sar, mc.f - mc.s as line, mc.g as sig, mc.f - mc.s - mc.g as hist from i3 join st using (symbol, ts) join sr using (symbol, ts) join mc using (symbol, ts))"""
#: The condition of each indicator signal over the table `ii`.
CONDITIONS = {
    "rsi_oversold": "rsi < 30", "rsi_overbought": "rsi > 70", "macd_bullish": "line > sig", "macd_bearish": "line < sig",
    "bollinger_upper_break": "close > mid + 2 * sd", "bollinger_lower_break": "close < mid - 2 * sd", "stochastic_oversold": "k < 20", "stochastic_overbought": "k > 80",
    "awesome_oscillator_positive": "ao > 0", "awesome_oscillator_negative": "ao < 0", "above_parabolic_sar": "close > sar", "below_parabolic_sar": "close < sar",
    "mfi_oversold": "mfi < 20", "mfi_overbought": "mfi > 80", "obv_rising": "obv > obv20", "obv_falling": "obv < obv20",
    "chaikin_money_flow_positive": "cmf > 0", "chaikin_money_flow_negative": "cmf < 0", "volume_surge_up": "volume > 2 * av and close > open", "volume_surge_down": "volume > 2 * av and close < open",
}


def long_table(ahead: int, signals: dict[str, str], candles: str = "", predicates: dict[str, str] | None = None, directions: dict[str, str] | None = None) -> str:
    """Tables up to `lg`: a row for each bar and signal with seen and fr, the return `ahead`."""
    parts = [f"select symbol, ts, '{n}' as name, '{d}' as direction, coalesce({CONDITIONS[n]}, false) as seen from ii" for n, d in signals.items()]
    parts += [f"select symbol, ts, '{n}' as name, '{d}' as direction, coalesce({predicates[n]}, false) as seen from k" for n, d in (directions or {}).items()]
    more = f", {candles}" if candles else ""
    return f"{INDICATORS}{more}, fr as (select symbol, ts, lead(close, {ahead}) over ({W}) / nullif(close, 0) - 1 as fr from bars), l0 as ({' union all '.join(parts)}), lg as (select l0.*, cast(ts as date) as day, fr, seen and fr is not null as hit from l0 join fr using (symbol, ts))"


def win_stats(source: str, by: str, name: str = "ws") -> str:
    return f"""{name} as (select {by}, name, direction, cast(count(*) filter (where hit) as bigint) as occurrences, case direction when 'bullish' then avg(cast(fr > 0 as double)) filter (where hit) when 'bearish' then avg(cast(fr < 0 as double)) filter (where hit) end as win_rate,
 avg(fr) filter (where hit) as avg_forward_return from {source} group by {by}, name, direction)"""


WEIGHT = "case when occurrences >= 5 and win_rate is not null and direction = 'bullish' then greatest(0.0, (win_rate - 0.5) * 2) when occurrences >= 5 and win_rate is not null and direction = 'bearish' then -greatest(0.0, (win_rate - 0.5) * 2) else 0.0 end"


def fold_table(before: int, test: int, by: str = "symbol, ") -> str:
    """Table `fo` of the days of folds, from `dy` (by, day)."""
    over = f"partition by {by.strip(', ')} " if by else ""
    return f"""dn0 as (select *, row_number() over ({over}order by day) - 1 as no, count(*) over ({over.strip()}) as many from dy), fo as (select {by}fold_id, case when no < fold_id * {test} + {before} then 'before' else 'test' end as part, day
 from dn0 join (select unnest(range(0, 2000)) as fold_id) on no >= fold_id * {test} and no < fold_id * {test} + {before + test} and fold_id * {test} + {before + test} <= many)"""


def scored(by: str) -> str:
    """Tables up to `sc`: the score of each test row, from `lg` and `fo`."""
    names = f"{by}day"
    return f"""tn as (select * from lg join fo using ({names}) where part = 'before'), {win_stats('tn', f'{by}fold_id')}, wt as (select {by}fold_id, name, {WEIGHT} as w from ws),
sc as (select t.symbol, t.fold_id, t.ts, t.fr, avg(w) filter (where seen and w <> 0) as score from (select * from lg join fo using ({names}) where part = 'test') t left join wt on wt.fold_id = t.fold_id and wt.name = t.name{' and wt.symbol = t.symbol' if by else ''} group by 1, 2, 3, 4)"""


def gauges() -> str:
    clip = lambda g, unknown: f"round(greatest(0.0, least(100.0, coalesce({g}, {unknown}))), 6)"
    label = lambda c, high, low, names: f"case when {c} > {high} then '{names[0]}' when {c} < {low} then '{names[2]}' else '{names[1]}' end"
    swing = "case when hist is not null then coalesce(hist / nullif(0.02 * close, 0), 0.0) end"
    rows = [
        ("rsi", "rsi", label("rsi", 70, 30, ("Overbought", "Neutral", "Oversold")), clip("rsi", 50.0)), ("macd", "hist", label("hist", 0, 0, ("Bullish", "Neutral", "Bearish")), clip(f"50 + 50 * {swing}", 50.0)),
        ("stochastic", "k", label("k", 80, 20, ("Overbought", "Neutral", "Oversold")), clip("k", 50.0)), ("adx", "adx", label("adx", 25, 20, ("Trending", "Transitional", "Ranging")), clip("adx", 30.0)),
        ("atr_pct", "la", label("ar", 1.5, 0.67, ("Elevated", "Normal", "Low")), clip("50 + 50 * (ar - 1)", 50.0)), ("volume", "vr", label("vr", 1.3, 0.7, ("Above average", "Average", "Below average")), clip("50 * vr", 50.0)),
        ("mfi", "mfi", label("mfi", 80, 20, ("Overbought", "Neutral", "Oversold")), clip("mfi", 50.0)), ("vwap", "dev", label("dev", 0.003, -0.003, ("Above VWAP", "At VWAP", "Below VWAP")), clip("50 + 50 * dev / 0.01", 50.0)),
    ]
    union = " union all ".join(f"select symbol, ts, '{n}' as gauge, round({v}, 6) as value, {x} as label, {g} as gauge_pct from y1" for n, v, x, g in rows)
    return f"""{INDICATORS}, {VWAP}, y0 as (select ii.*, vwap, atr / nullif(ii.close, 0) as ap, row_number() over (partition by symbol order by ts desc) as back from ii join v using (symbol, ts)),
ym as (select symbol, median(ap) as med, arg_max(ap, ts) filter (where ap is not null) as la from y0 group by 1),
y1 as (select y0.*, la, case when la is not null then case when med > 0 then la / med else 1.0 end end as ar, case when av1 > 0 then volume / av1 else 1.0 end as vr, case when vwap is not null then case when vwap > 0 then (close - vwap) / vwap else 0.0 end end as dev from y0 join ym using (symbol) where back = 1) {union}"""
