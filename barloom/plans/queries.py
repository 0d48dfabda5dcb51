"""Every registered query of the library outside `llm`, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import last_rows, series
from ..operators import analysis as A
from ..operators import backtest as B
from ..operators import candles, chart, documents, frames, journal, metrics, strategies, sweep, table_functions, ticks
from ..operators import indicators as I
from ..sources import feeds, provider, records, store
from ..sources import fixtures as S
from ..streaming import bars as stream
from . import shape_sql as Y
from . import signal_sql as X

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

HOURLY = """bars as (select event_type as symbol, cast(date_trunc('hour', ts) as timestamp) as ts, arg_min(value, ts) as open, max(value) as high,
 min(value) as low, arg_max(value, ts) as close, cast(count(*) as double) as volume from events group by 1, 2)"""
DAILY = """bars as (select o_orderpriority as symbol, cast(o_orderdate as timestamp) as ts, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high,
 min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume from orders group by 1, 2)"""
NUMBERED = "n as (select *, row_number() over (partition by symbol order by ts) as rn from bars)"
W = "partition by symbol order by ts"


def last(n: int, end: str = "current row") -> str:
    return f"({W} rows between {n - 1 if end == 'current row' else n} preceding and {end})"


def query(name: str, sql: str | None = None, bars: str = HOURLY):
    """Register a query; `sql` follows the common table of bars, or stands without any, or begins with tables of its own (+)."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = f"with recursive {sql}" if bars == "+" else (f"with recursive {bars}" + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().lstrip("+")) if bars else sql
        return fn

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def simple(name: str, make, columns: list[str], sql: str | None = None, source=S.hourly, bars: str = HOURLY) -> None:
    """symbol, ts and rounded columns of what `make` adds to the bars."""

    def fn(spark, sf_dir):
        df = make(source(spark, sf_dir))
        kinds = dict(df.dtypes)
        return df.select("symbol", "ts", *(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))

    query(name, sql, bars)(fn)


# Bars and sessions
simple("bars_hourly", lambda b: b, ["open", "high", "low", "close", "volume"], "select symbol, ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume from bars")
simple("bars_daily", lambda b: b, ["open", "high", "low", "close", "volume"], "select symbol, ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume from bars", S.daily, DAILY)


@query("upsert_keep_last", """select symbol, ts, round(case when hour(ts) % 3 = 0 then close + 1 else close end, 6) as close from bars where not (hour(ts) % 6 = 3)""")
def _upsert(spark, sf_dir):
    b = S.hourly(spark, sf_dir)
    new = b.where(F.hour("ts") % 3 == 0).withColumn("close", F.col("close") + 1).withColumn("open", F.when(F.hour("ts") % 6 != 3, F.col("open")))
    return rounded(frames.upsert(b, new).select("symbol", "ts", "close"), "close")


@query("slice_inclusive", "select symbol, count(*) as n from bars where ts >= '2024-01-05' and ts < '2024-01-11' group by 1")
def _slice(spark, sf_dir):
    return frames.between(S.hourly(spark, sf_dir), "2024-01-05", "2024-01-10").groupBy("symbol").agg(F.count("*").alias("n"))


@query("resample_daily", """select symbol, cast(ts as date) as session_date, round(arg_min(open, ts), 6) as open, round(max(high), 6) as high, round(min(low), 6) as low, round(arg_max(close, ts), 6) as close, sum(volume) as volume
 from bars group by 1, 2""")
def _resample(spark, sf_dir):
    return rounded(frames.resample_daily(S.hourly(spark, sf_dir)), "open", "high", "low", "close")


@query("bar_minutes", f"""+ d as (select symbol, epoch_us(ts) / 6e7 - lag(epoch_us(ts) / 6e7) over ({W}) as g from bars), c as (select symbol, round(g, 6) as g, count(*) as k from d where g > 0 group by 1, 2)
 select symbol, arg_max(g, (k, -g)) as bar_minutes from c group by 1""")
def _minutes(spark, sf_dir):
    return rounded(frames.bar_minutes(S.hourly(spark, sf_dir)), "bar_minutes")


simple("forward_return", lambda b: frames.forward_return(b, 10), ["forward_return"], f"select symbol, ts, round(lead(close, 10) over ({W}) / nullif(close, 0) - 1, 6) as forward_return from bars")
simple("opening_range", lambda b: frames.opening_range(b, 150), ["or_high", "or_low"], f"""+ r as (select *, cast(ts as date) as d, row_number() over (partition by symbol, cast(ts as date) order by ts) as rn from bars)
 select symbol, ts, round(max(case when rn <= 2 then high end) over (partition by symbol, d), 6) as or_high, round(min(case when rn <= 2 then low end) over (partition by symbol, d), 6) as or_low from r""")
VWAP = """v as (select *, sum((high + low + close) / 3 * volume) over (partition by symbol, cast(ts as date) order by ts rows unbounded preceding) / nullif(sum(volume) over (partition by symbol, cast(ts as date) order by ts rows unbounded preceding), 0) as vwap from bars)"""
simple("session_vwap", frames.session_vwap, ["vwap"], f"+ {VWAP} select symbol, ts, round(vwap, 6) as vwap from v")


def full(expr: str, n: int, of: str = "close", end: str = "current row") -> str:
    """A guarded rolling aggregate; {w} stands for the frame."""
    w = last(n, end)
    return f"case when count({of}) over {w} >= {n} then {expr.format(w=f'over {w}')} end"


# Providers, feeds and stores
@query("fetch_history", """with m as (select upper(event_type) as symbol, date_trunc('minute', ts) as utc, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, cast(count(*) as double) as volume from events group by 1, 2)
 select symbol, '1m' as interval, cast(utc - interval 5 hour as timestamp) as ts, open, high, low, close, volume from m where utc >= '2024-01-11' and utc < '2024-02-10'""", "")
def _history(spark, sf_dir):
    """Minute bars of the thirty days to 10 February, in requests of a week each, of which the last are empty."""
    return provider.fetch_max_available(spark, S.provider_archive(spark, sf_dir), "1m", until=date(2024, 2, 10))


FEED_SQL = """with e as (select *, 'S' || (user_id % 3) as symbol, cast(case when event_id % 10 = 0 then date_trunc('hour', ts) else ts end as timestamp) - interval 5 hour as tm from events),
 o as (select *, row_number() over (partition by event_type, symbol, tm order by event_id desc) as rn from e)"""
FEED_ROWS = """select symbol, tm as ts, case event_type when 'click' then 'databento' else 'alpaca' end as source, case event_type when 'view' then 'quotes' else 'trades' end as kind,
 case when event_type <> 'view' then value end as price, case when event_type <> 'view' then cast(1 + event_id % 5 as double) end as size, case when event_type = 'purchase' then cast(event_id % 4 as varchar) end as exchange,
 case when event_type = 'purchase' then '@' || event_id % 2 end as conditions, case when event_type = 'click' then case when event_id % 2 = 0 then 'A' else 'B' end end as side, case when event_type = 'click' then cast(event_id % 7 as int) end as publisher_id,
 case when event_type = 'view' then value - 1 end as bid_price, case when event_type = 'view' then value + 1 end as ask_price, case when event_type = 'view' then cast(1 + event_id % 5 as double) end as bid_size, case when event_type = 'view' then 'V' end as bid_exchange
 from o where event_type in ('purchase', 'view', 'click') and (event_type = 'click' or rn = 1)"""


def _feeds(spark, sf_dir, start: str, end: str) -> DataFrame:
    root, out = S.feed_archive(spark, sf_dir), None
    for source, kind in feeds.FEEDS:
        some = feeds.get_ticks(spark, root, ["S0", "S1", "S2"], start, end, source, kind)
        out = some if out is None else out.unionByName(some)
    return out.withColumn("conditions", F.array_join("conditions", "")).drop("ask_size", "ask_exchange", "seq")


@query("ticks_by_feed", f"{FEED_SQL} {FEED_ROWS} and tm between '2024-01-03 09:30:00' and '2024-01-20 16:00:00'", "")
def _ticks_by_feed(spark, sf_dir):
    """Trades and quotes of two sources as one table."""
    return _feeds(spark, sf_dir, "2024-01-03 09:30:00", "2024-01-20 16:00:00")


@query("ticks_cached", f"""{FEED_SQL} select symbol, cast(tm as date) as date, count(distinct tm) as n, sum(case when rn = 1 then cast(1 + event_id % 5 as double) end) as size, cast(tm as date) < '2024-01-12' as kept
 from o where event_type = 'click' and symbol <> 'S2' and cast(tm as date) between '2024-01-03' and '2024-01-12' group by symbol, cast(tm as date)""", "")
def _ticks_cached(spark, sf_dir):
    """Days asked for twice: the second time only the gaps are fetched, and the last day, which is today's, isn't kept."""
    root, path = S.feed_archive(spark, sf_dir), S.shared_dir(spark)

    def fetch(days):
        ticks = feeds.as_ticks(spark.read.parquet(f"{root}/databento/trades"), "databento", "trades")
        return ticks.withColumn("date", F.to_date("ts")).join(days, ["symbol", "date"], "left_semi").drop("date")

    ask = lambda a, b: store.get_ticks_cached(spark, path, fetch, ["S0", "S1"], date(2024, 1, a), date(2024, 1, b), "databento", "trades", date(2024, 1, 12))
    ask(5, 8)
    rows = ask(3, 12).withColumn("date", F.to_date("ts"))
    kept = spark.read.schema(store.DAYS).parquet(f"{path}/days").select("symbol", "date", F.lit(True).alias("kept"))
    return rows.groupBy("symbol", "date").agg(F.count("*").alias("n"), F.sum("size").alias("size")).join(kept, ["symbol", "date"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@query("stored_bars", "select symbol, ts, round(case when symbol = 'purchase' then close + 1 else close end, 6) as close, volume from bars where symbol <> 'view'")
def _stored_bars(spark, sf_dir):
    """Bars stored, and then an update that raises one symbol and deletes all rows of another."""
    path, b = S.shared_dir(spark), S.hourly(spark, sf_dir).withColumn("interval", F.lit("1h"))
    store.save_bars(spark, path, b)
    raised = F.when(F.col("symbol") == "purchase", F.col("close") + 1)
    store.save_bars(spark, path, b.where("symbol in ('purchase', 'view')").withColumn("close", raised))
    return rounded(store.read_bars(spark, path, interval="1h").select("symbol", "ts", "close", "volume"), "close")


# Indicators of bounded frames
simple("sma", lambda b: I.sma(b, 20), ["sma"], f"select symbol, ts, round({full('avg(close) {w}', 20)}, 6) as sma from bars")
simple("bollinger", I.bollinger, ["bb_mid", "bb_upper", "bb_lower"], f"""+ m as (select *, {full('avg(close) {w}', 20)} as m, {full('stddev_samp(close) {w}', 20)} as s from bars)
 select symbol, ts, round(m, 6) as bb_mid, round(m + 2 * s, 6) as bb_upper, round(m - 2 * s, 6) as bb_lower from m""")
simple("stochastic", I.stochastic, ["stoch_k", "stoch_d"], f"""+ m as (select *, {full('min(low) {w}', 14)} as lo, {full('max(high) {w}', 14)} as hi from bars), k as (select *, 100 * (close - lo) / nullif(hi - lo, 0) as k from m)
 select symbol, ts, round(k, 6) as stoch_k, round({full('avg(k) {w}', 3, 'k')}, 6) as stoch_d from k""")
simple("money_flow_index", I.money_flow_index, ["mfi"], f"""+ t as (select *, (high + low + close) / 3 as tp from bars), r as (select *, coalesce(tp > lag(tp) over ({W}), false) as up from t),
 f as (select *, case when up then tp * volume else 0 end as a, case when up then 0 else tp * volume end as z from r)
 select symbol, ts, round(coalesce(100 - 100 / (1 + ({full('sum(a) {w}', 14, 'a')}) / nullif({full('sum(z) {w}', 14, 'z')}, 0)), 50), 6) as mfi from f""")
simple("on_balance_volume", I.on_balance_volume, ["obv"], f"""+ s as (select *, coalesce(sign(close - lag(close) over ({W})), 0) * volume as s from bars) select symbol, ts, round(sum(s) over ({W} rows unbounded preceding), 6) as obv from s""")
simple("chaikin_money_flow", I.chaikin_money_flow, ["cmf"], f"""+ f as (select *, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume as f from bars)
 select symbol, ts, round(coalesce(({full('sum(f) {w}', 20, 'f')}) / nullif({full('sum(volume) {w}', 20, 'volume')}, 0), 0), 6) as cmf from f""")
simple("volume_surge", I.volume_surge, ["volume_surge"], f"select symbol, ts, coalesce(volume > 2 * ({full('avg(volume) {w}', 20, 'volume')}), false) as volume_surge from bars")
simple("awesome_oscillator", I.awesome_oscillator, ["ao"], f"""+ m as (select *, (high + low) / 2 as m from bars) select symbol, ts, round(({full('avg(m) {w}', 5, 'm')}) - ({full('avg(m) {w}', 34, 'm')}), 6) as ao from m""")
simple("true_range", I.true_range, ["true_range"], f"""+ p as (select *, lag(close) over ({W}) as p from bars) select symbol, ts, round(greatest(high - low, abs(high - p), abs(low - p)), 6) as true_range from p""")
CONTRACTION = f"""+ r as (select *, {full('avg(high - low) {w}', 20)} as r from bars),
 q as (select *, quantile_cont(r, 0.2) over ({W} rows unbounded preceding) as q, count(r) over ({W} rows unbounded preceding) as m from r) select symbol, ts, coalesce(r <= q and m >= 20, false) as contraction from q"""
simple("range_contraction", I.range_contraction, ["contraction"], CONTRACTION)
simple("range_contraction_sliced", lambda b: I.range_contraction(b, slice_="week"), ["contraction"], CONTRACTION)


def recursive(first: str, step: str, columns: str, out: str, more: str = "") -> str:
    """A recurrence over each series: `first` at rn 1, `step` from r (before) and n (now)."""
    return f"+ {NUMBERED}{more}, r as (select symbol, ts, rn, {first} from n where rn = 1 union all select n.symbol, n.ts, n.rn, {step} from r join n on n.symbol = r.symbol and n.rn = r.rn + 1) select symbol, ts, {out} from r"


def ewm_sql(alpha: float, name: str) -> str:
    return recursive("close as y", f"r.y * (1 - {alpha!r}) + n.close * {alpha!r}", "", f"round(y, 6) as {name}")


simple("ema", lambda b: I.ema(b, 20), ["ema"], ewm_sql(2 / 21, "ema"))
simple("ema_sliced", lambda b: I.ema(b, 20, slice_="week"), ["ema"], ewm_sql(2 / 21, "ema"))
simple("macd", I.macd, ["macd_line", "macd_signal", "macd_histogram"], recursive(
    "close as f, close as s, cast(0 as double) as g", "r.f * 11 / 13 + n.close * 2 / 13, r.s * 25 / 27 + n.close * 2 / 27, r.g * 0.8 + ((r.f * 11 / 13 + n.close * 2 / 13) - (r.s * 25 / 27 + n.close * 2 / 27)) * 0.2", "",
    "round(f - s, 6) as macd_line, round(g, 6) as macd_signal, round(f - s - g, 6) as macd_histogram"))
CHANGES = f", c as (select *, coalesce(close - lag(close) over ({W}), 0) as d from n)"
STRENGTH_OF_MOVES = f"""+ {NUMBERED}{CHANGES}, r as (select symbol, ts, rn, cast(null as double) as g, cast(null as double) as l from c where rn = 1
 union all select c.symbol, c.ts, c.rn, coalesce(r.g * 13 / 14 + greatest(c.d, 0) / 14, greatest(c.d, 0)), coalesce(r.l * 13 / 14 + greatest(-c.d, 0) / 14, greatest(-c.d, 0)) from r join c on c.symbol = r.symbol and c.rn = r.rn + 1)
 select symbol, ts, round(case when rn > 14 and l <> 0 then 100 - 100 / (1 + g / l) else 50 end, 6) as rsi from r"""
simple("rsi", I.rsi, ["rsi"], STRENGTH_OF_MOVES)
simple("rsi_sliced", lambda b: I.rsi(b, slice_="week"), ["rsi"], STRENGTH_OF_MOVES)
RANGES = f", c as (select *, greatest(high - low, abs(high - lag(close) over ({W})), abs(low - lag(close) over ({W}))) as t from n)"
simple("average_true_range", I.average_true_range, ["atr", "atr_pct"], f"""+ {NUMBERED}{RANGES}, r as (select symbol, ts, rn, close, t as a from c where rn = 1
 union all select c.symbol, c.ts, c.rn, c.close, r.a * 13 / 14 + c.t / 14 from r join c on c.symbol = r.symbol and c.rn = r.rn + 1)
 select symbol, ts, round(case when rn >= 14 then a end, 6) as atr, round(case when rn >= 14 then a / nullif(close, 0) end, 6) as atr_pct from r""")
simple("heikin_ashi", I.heikin_ashi, ["ha_open", "ha_high", "ha_low", "ha_close"], recursive(
    "open as o, (open + high + low + close) / 4 as c, high as h, low as l", "(r.o + r.c) / 2, (n.open + n.high + n.low + n.close) / 4, n.high, n.low", "",
    "round(o, 6) as ha_open, round(greatest(o, c, h), 6) as ha_high, round(least(o, c, l), 6) as ha_low, round(c, 6) as ha_close"))
simple("adx", I.adx, ["adx"], f"+ {X.STRENGTH} select symbol, ts, round(adx, 6) as adx from st")
simple("adx_sliced", lambda b: I.adx(b, slice_="week"), ["adx"], f"+ {X.STRENGTH} select symbol, ts, round(adx, 6) as adx from st")
simple("parabolic_sar", I.parabolic_sar, ["sar"], f"+ {X.NUMBERED}, {X.SAR} select symbol, ts, round(sar, 6) as sar from sr")
_OVER = X.recurrence("oc", "c", "cast(0 as double) as g, cast(0 as double) as l", "r.g * 13 / 14 + greatest(n.ch, 0) / 14, r.l * 13 / 14 + greatest(-n.ch, 0) / 14")
simple("chart_overlays", I.overlays, ["rsi_chart", "vwap_chart", "stoch_k", "stoch_d_chart", "bb_mid", "bb_upper", "bb_lower"], f"""+ {X.NUMBERED}, {X.MOVES}, {_OVER}, {VWAP}, o0 as (select *, {full('min(low) {w}', 14)} as lo, {full('max(high) {w}', 14)} as hi, {full('avg(close) {w}', 20)} as m, {full('stddev_pop(close) {w}', 20)} as sd from v),
 o1 as (select *, 100 * (close - lo) / nullif(hi - lo, 0) as k from o0), o2 as (select *, {full('avg(k) {w}', 3, 'k')} as kd from o1)
 select o2.symbol, o2.ts, round(case when rn > 14 then case when l <> 0 then 100 - 100 / (1 + g / l) else 100 end end, 6) as rsi_chart, round(coalesce(vwap, close), 6) as vwap_chart, round(k, 6) as stoch_k, round(kd, 6) as stoch_d_chart, round(m, 6) as bb_mid, round(m + 2 * sd, 6) as bb_upper, round(m - 2 * sd, 6) as bb_lower
 from o2 join oc on oc.symbol = o2.symbol and oc.ts = o2.ts""")

# Candles: the oracle writes the bearish shapes out, where the library mirrors the bullish ones
CANDLES = "k as (select *, " + ", ".join(f"lag({c}, {k}) over ({W}) as {c[0]}{k}" for c in ("open", "high", "low", "close") for k in (1, 2)) + f", sign(lag(close, 1) over ({W}) - lag(close, 6) over ({W})) as tr from bars)"
_B, _R, _U, _L = "abs(close - open)", "(high - low)", "(high - greatest(open, close))", "(least(open, close) - low)"
PREDICATES = {
    "doji": f"{_R} <> 0 and {_B} <= 0.1 * {_R}",
    "hammer": f"{_R} <> 0 and {_B} <= 0.3 * {_R} and {_L} >= 2 * {_B} and {_U} <= 0.1 * {_R} and tr < 0",
    "hanging_man": f"{_R} <> 0 and {_B} <= 0.3 * {_R} and {_L} >= 2 * {_B} and {_U} <= 0.1 * {_R} and tr > 0",
    "shooting_star": f"{_R} <> 0 and {_B} <= 0.3 * {_R} and {_U} >= 2 * {_B} and {_L} <= 0.1 * {_R} and tr > 0",
    "inverted_hammer": f"{_R} <> 0 and {_B} <= 0.3 * {_R} and {_U} >= 2 * {_B} and {_L} <= 0.1 * {_R} and tr < 0",
    "bullish_engulfing": "c1 < o1 and close > open and open <= c1 and close >= o1", "bearish_engulfing": "c1 > o1 and close < open and open >= c1 and close <= o1",
    "morning_star": "c2 < o2 and h2 <> l2 and abs(o2 - c2) >= 0.5 * (h2 - l2) and h1 <> l1 and abs(c1 - o1) <= 0.3 * (h1 - l1) and close > open and close > (o2 + c2) / 2",
    "evening_star": "c2 > o2 and h2 <> l2 and abs(o2 - c2) >= 0.5 * (h2 - l2) and h1 <> l1 and abs(c1 - o1) <= 0.3 * (h1 - l1) and close < open and close < (o2 + c2) / 2",
    "morning_star_forming": f"c1 < o1 and h1 <> l1 and abs(o1 - c1) >= 0.5 * (h1 - l1) and {_R} <> 0 and {_B} <= 0.3 * {_R}",
    "evening_star_forming": f"c1 > o1 and h1 <> l1 and abs(o1 - c1) >= 0.5 * (h1 - l1) and {_R} <> 0 and {_B} <= 0.3 * {_R}",
    "three_white_soldiers": f"c2 > o2 and c1 > o1 and close > open and c1 > c2 and close > c1 and o1 > o2 and o1 < c2 and open > o1 and open < c1 and h2 <> l2 and h2 - c2 <= 0.25 * (h2 - l2) and h1 <> l1 and h1 - c1 <= 0.25 * (h1 - l1) and {_R} <> 0 and high - close <= 0.25 * {_R}",
    "three_black_crows": f"c2 < o2 and c1 < o1 and close < open and c1 < c2 and close < c1 and o1 < o2 and o1 > c2 and open < o1 and open > c1 and h2 <> l2 and c2 - l2 <= 0.25 * (h2 - l2) and h1 <> l1 and c1 - l1 <= 0.25 * (h1 - l1) and {_R} <> 0 and close - low <= 0.25 * {_R}",
}
for _n, _p in PREDICATES.items():
    simple(f"cand_{_n}", candles.candle_patterns, [_n], f"+ {CANDLES} select symbol, ts, coalesce({_p}, false) as {_n} from k", S.daily, DAILY)


def _ramp(x: str, lo: float, hi: float) -> str:
    return f"(case when ({x}) is not null then greatest(0, least(1, (({x}) - ({lo})) / ({hi} - ({lo})))) end)"


CONFIDENCES = {
    "doji": _ramp(f"-{_B} / nullif({_R}, 0)", -0.1, 0.0),
    "bullish_engulfing": _ramp(f"{_B} / nullif(abs(c1 - o1), 0)", 1.0, 2.5), "bearish_engulfing": _ramp(f"{_B} / nullif(abs(c1 - o1), 0)", 1.0, 2.5),
    **dict.fromkeys(("hammer", "hanging_man"), f"({_ramp(f'-{_B} / nullif({_R}, 0)', -0.3, 0.0)} + {_ramp(f'{_L} / nullif({_B}, 0)', 2.0, 4.0)} + {_ramp(f'-{_U} / nullif({_R}, 0)', -0.1, 0.0)}) / 3"),
    **dict.fromkeys(("shooting_star", "inverted_hammer"), f"({_ramp(f'-{_B} / nullif({_R}, 0)', -0.3, 0.0)} + {_ramp(f'{_U} / nullif({_B}, 0)', 2.0, 4.0)} + {_ramp(f'-{_L} / nullif({_R}, 0)', -0.1, 0.0)}) / 3"),
    **dict.fromkeys(("morning_star", "evening_star"), f"({_ramp('abs(o2 - c2) / nullif(h2 - l2, 0)', 0.5, 0.9)} + {_ramp('-abs(c1 - o1) / nullif(h1 - l1, 0)', -0.3, 0.0)} + {_ramp('abs(close - (o2 + c2) / 2) / nullif(abs(o2 - c2), 0)', 0.0, 1.0)}) / 3"),
    "three_white_soldiers": f"({_ramp(f'-((h2 - c2) / nullif(h2 - l2, 0) + (h1 - c1) / nullif(h1 - l1, 0) + (high - close) / nullif({_R}, 0)) / 3', -0.25, 0.0)} + {_ramp('(close - c2) / 2 / nullif(h1 - l1, 0)', 0.0, 0.5)}) / 2",
    "three_black_crows": f"({_ramp(f'-((c2 - l2) / nullif(h2 - l2, 0) + (c1 - l1) / nullif(h1 - l1, 0) + (close - low) / nullif({_R}, 0)) / 3', -0.25, 0.0)} + {_ramp('(c2 - close) / 2 / nullif(h1 - l1, 0)', 0.0, 0.5)}) / 2",
}
for _n, _c in CONFIDENCES.items():
    simple(f"conf_{_n}", candles.candle_patterns, [f"conf_{_n}"], f"+ {CANDLES} select symbol, ts, round(case when coalesce({PREDICATES[_n]}, false) then coalesce(100 * {_c}, 0) else cast(0 as double) end, 6) as conf_{_n} from k", S.daily, DAILY)


# Strategies
def level_sql(ctes: str, long: str, short: str, table: str) -> str:
    return f"+ {ctes} select symbol, ts, case when {short} then -1 when {long} then 1 else 0 end as signal from {table}" if ctes else f"select symbol, ts, case when {short} then -1 when {long} then 1 else 0 end as signal from {table}"


PRIOR = f"c as (select *, {full('max(high) {w}', 20, 'high', '1 preceding')} as ph, {full('min(low) {w}', 20, 'low', '1 preceding')} as pl, {full('avg(volume) {w}', 20, 'volume', '1 preceding')} as av from bars)"
_AO = f"m as (select *, (high + low) / 2 as m from bars), a as (select *, ({full('avg(m) {w}', 5, 'm')}) - ({full('avg(m) {w}', 34, 'm')}) as ao from m)"
_DT = """d as (select symbol, cast(ts as date) as d, arg_min(open, ts) as o, max(high) as h, min(low) as l, arg_max(close, ts) as c from bars group by 1, 2),
 e as (select *, count(*) over w as k, max(h) over w - min(c) over w as x, max(c) over w - min(l) over w as y from d window w as (partition by symbol order by d rows between 4 preceding and 1 preceding)),
 t as (select b.*, o + 0.5 * case when k >= 4 then greatest(x, y) end as buy, o - 0.5 * case when k >= 4 then greatest(x, y) end as sell from bars b join e on e.symbol = b.symbol and e.d = cast(b.ts as date))"""
SIGNAL_SQL = {
    "orb": level_sql("r as (select *, cast(ts as date) as d, row_number() over (partition by symbol, cast(ts as date) order by ts) as rn from bars), o as (select *, max(case when rn <= 1 then high end) over (partition by symbol, d) as oh, min(case when rn <= 1 then low end) over (partition by symbol, d) as ol from r)", "close > oh", "close < ol", "o"),
    "vwap_reversion": level_sql(f"{VWAP}, d as (select *, close - vwap as dev from v), s as (select *, {full('stddev_samp(dev) {w}', 30, 'dev')} as sd from d)", "dev < -sd", "dev > sd", "s"),
    "volume_momentum": level_sql(PRIOR, "close > ph and volume > 2 * av", "close < pl and volume > 2 * av", "c"),
    "awesome_oscillator": level_sql(_AO, "ao > 0", "ao < 0", "a"),
    "dual_thrust": level_sql(_DT, "close > buy", "close < sell", "t"),
    "bollinger_reversion": level_sql(f"m as (select *, {full('avg(close) {w}', 20)} as m, {full('stddev_samp(close) {w}', 20)} as s from bars)", "close <= m - 2 * s", "close >= m + 2 * s", "m"),
    "candlestick_reversal": level_sql(CANDLES, " or ".join(f"coalesce({PREDICATES[n]}, false)" for n in ("hammer", "bullish_engulfing", "morning_star", "three_white_soldiers")), " or ".join(f"coalesce({PREDICATES[n]}, false)" for n in ("hanging_man", "bearish_engulfing", "evening_star", "three_black_crows")), "k"),
}
TABLES = X.strategy_tables(CANDLES, *(" or ".join(f"coalesce({PREDICATES[n]}, false)" for n in names) for names in (("hammer", "bullish_engulfing", "morning_star", "three_white_soldiers"), ("hanging_man", "bearish_engulfing", "evening_star", "three_black_crows"))))
AO_TABLES = X.signals(*TABLES["awesome_oscillator"][:4], *TABLES["awesome_oscillator"][4]["zero_cross"])


def signal_sql(name: str, mode: str, columns: str) -> str:
    return f"+ {X.signals(*TABLES[name][:4], *TABLES[name][4][mode])} select symbol, ts, signal{columns} from sg"


for _name, _s in strategies.REGISTRY.items():
    for _i, _mode in enumerate(_s.modes):
        def _signal(spark, sf_dir, name=_name, mode=_mode):
            return rounded(strategies.signals(S.hourly(spark, sf_dir), name, mode).select("symbol", "ts", "signal", "stop_price", "target_price"), "stop_price", "target_price")

        if _i == 0:
            query(f"sig_{_name}", SIGNAL_SQL.get(_name) or signal_sql(_name, _mode, ""))(lambda spark, sf_dir, name=_name: strategies.signals(S.hourly(spark, sf_dir), name).select("symbol", "ts", "signal"))
        else:
            query(f"sig_{_name}_{_mode}", signal_sql(_name, _mode, ", round(stop_price, 6) as stop_price, round(target_price, 6) as target_price"))(_signal)
query("sig_buy_and_hold", "select symbol, ts, 1 as signal from bars")(lambda spark, sf_dir: strategies.buy_and_hold(S.hourly(spark, sf_dir)).select("symbol", "ts", "signal"))
query("sig_bollinger_sliced", signal_sql("bollinger_reversion", "midline", ""))(lambda spark, sf_dir: strategies.signals(S.hourly(spark, sf_dir), "bollinger_reversion", "midline", "week").select("symbol", "ts", "signal"))
for _mode in ("level_reversal", "vertex_stop", "measured_move"):
    query("sig_chart_pattern_breakout" + ("" if _mode == "level_reversal" else f"_{_mode}"), f"+ {Y.patterns()}, {Y.signals(_mode)} select symbol, ts, signal, stop_price, target_price from sg")(lambda spark, sf_dir, mode=_mode: chart.breakout_signals(S.hourly(spark, sf_dir), mode).select("symbol", "ts", "signal", "stop_price", "target_price"))


@query("debounce", f"""+ {_AO}, s as (select *, case when ao < 0 then -1 when ao > 0 then 1 else 0 end as raw from a), g as (select *, row_number() over ({W}) - row_number() over (partition by symbol, raw order by ts) as g from s),
 l as (select *, row_number() over (partition by symbol, raw, g order by ts) as len from g) select symbol, ts, coalesce(last_value(case when len >= 3 then raw end ignore nulls) over ({W} rows unbounded preceding), 0) as signal from l""")
def _debounce(spark, sf_dir):
    return strategies.signals(S.hourly(spark, sf_dir), "awesome_oscillator", "confirmed_reversal").select("symbol", "ts", "signal")


# Back-tests
AO_SIGNALS = f"{_AO}, s as (select *, case when ao < 0 then -1 when ao > 0 then 1 else 0 end as signal from a)"
EOD = f"""{AO_SIGNALS}, e as (select *, case when row_number() over (partition by symbol, cast(ts as date) order by ts desc) <= 1 and count(*) over (partition by symbol, cast(ts as date)) > 1 then 0 else signal end as flat from s)"""
RUNS = f"""{EOD}, p as (select *, coalesce(lag(flat) over ({W}), 0) as position, row_number() over ({W}) - 1 as i from e), q as (select *, case when position is distinct from lag(position) over ({W}) or i = 0 then 1 else 0 end as nw from p),
 u as (select *, sum(nw) over ({W} rows unbounded preceding) as run from q)"""


def _ao_signals(spark, sf_dir):
    return strategies.signals(S.hourly(spark, sf_dir), "awesome_oscillator")


@query("eod_flatten", f"+ {EOD} select symbol, ts, flat as signal from e")
def _eod(spark, sf_dir):
    return B.flatten_eod(_ao_signals(spark, sf_dir)).select("symbol", "ts", "signal")


@query("position_runs", f"+ {RUNS} select symbol, ts, position, cast(run as bigint) as run from u")
def _position_runs(spark, sf_dir):
    return B.positions(_ao_signals(spark, sf_dir)).select("symbol", "ts", "position", F.col("run").cast("bigint").alias("run"))


TRADES = f"""{RUNS}, x as (select *, lead(open) over ({W}) as nxt, lead(ts) over ({W}) as nts from u), z as (select symbol, run, any_value(position) as side, min(ts) as t0, arg_min(open, i) as o, arg_max(nxt, i) as nx, arg_max(close, i) as lc, max(i) as i1, arg_max(coalesce(nts, ts), i) as t1 from x where position <> 0 group by 1, 2),
 y as (select *, o * (1 + 0.0001 * side) as ep, coalesce(nx * (1 - 0.0001 * side), lc) as xp, row_number() over (partition by symbol order by run) as k from z),
 f as (select symbol, k, run, side, ep, xp, t0, t1, cast(0 as double) as before, floor(100000 / ep) as qty, greatest(-100000, floor(100000 / ep) * side * (xp - ep)) as realised from y where k = 1
 union all select y.symbol, y.k, y.run, y.side, y.ep, y.xp, y.t0, y.t1, f.realised, greatest(0, floor((100000 + f.realised) / y.ep)), greatest(-100000, f.realised + greatest(0, floor((100000 + f.realised) / y.ep)) * y.side * (y.xp - y.ep)) from f join y on y.symbol = f.symbol and y.k = f.k + 1)"""


@query("trades", f"+ {TRADES} select symbol, t0 as entry_time, t1 as exit_time, side, cast(qty as bigint) as qty, round(ep, 4) as entry_price, round(xp, 4) as exit_price, round(qty * side * (xp - ep), 4) as pnl from f where qty > 0")
def _trades(spark, sf_dir):
    t = B.run(_ao_signals(spark, sf_dir))[1]
    return rounded(t.select("symbol", "entry_time", "exit_time", "side", "qty", "entry_price", "exit_price", "pnl"), "entry_price", "exit_price", "pnl", places=4)


@query("equity_curve", f"""+ {TRADES} select u.symbol, u.ts, u.position, round(case when u.position = 0 then 100000 + coalesce(last_value(f.realised ignore nulls) over (partition by u.symbol order by u.ts rows unbounded preceding), 0)
 when f.qty <= 0 then 100000 + f.before else greatest(0, 100000 + f.before + f.qty * u.position * (u.close - f.ep)) end, 4) as equity from u left join f on f.symbol = u.symbol and f.run = u.run""")
def _equity(spark, sf_dir):
    return rounded(B.run(_ao_signals(spark, sf_dir))[0].select("symbol", "ts", "position", "equity"), "equity", places=4)


FIGURES = ("total_return", "annualized_return", "sharpe_ratio", "sortino_ratio", "max_drawdown", "win_rate", "profit_factor", "avg_trade_return_pct")


@query("metrics", f"+ {AO_TABLES}, {X.account()}, {X.METRICS} select * from mt")
def _metrics(spark, sf_dir):
    return rounded(metrics.metrics(*B.run(_ao_signals(spark, sf_dir))), *FIGURES)


@query("bracket_trades", f"""+ {X.signals(*TABLES["candlestick_reversal"][:4], *TABLES["candlestick_reversal"][4]["candle_stop"])}, {X.account(False, 1.0)} select symbol, cast(run as bigint) as run, t0 as entry_time, round(ep, 4) as entry_price, t1 as exit_time, round(xp, 4) as exit_price, side, cast(qty as bigint) as qty,
 round(pnl, 4) as pnl, round(pnl / (qty * ep), 6) as return_pct from tr where qty > 0""")
def _bracket(spark, sf_dir):
    t = B.run(strategies.signals(S.hourly(spark, sf_dir), "candlestick_reversal", "candle_stop"), B.Config(execution_timing="same_close", commission_per_trade=1.0))[1]
    t = t.withColumn("run", F.col("run").cast("bigint")).drop("commission", "slippage")
    return rounded(rounded(t, "entry_price", "exit_price", "pnl", places=4), "return_pct")


@query("best_worst_periods", f"+ {AO_TABLES}, {X.account()}, {X.EXTREMES} select symbol, kind, from_ts, to_ts, round(change, 4) as change, round(change_pct, 6) as change_pct from ex")
def _periods(spark, sf_dir):
    return rounded(rounded(metrics.best_and_worst(B.run(_ao_signals(spark, sf_dir))[0]), "change", places=4), "change_pct")


NAMES = list(strategies.registered())


SETTINGS = [{"fast": f, "slow": s} for f in (5, 9, 12) for s in (20, 26, 34)]
_SETS = ", ".join(f"({k}, {s['fast']}, {s['slow']})" for k, s in enumerate(SETTINGS))
SWEPT = HOURLY.replace("bars as", "raw as", 1) + f""", ps as (select * from (values {_SETS}) as v(set_id, fast, slow)),
 bars as (select symbol || '#' || set_id as symbol, ts, open, high, low, close, volume, fast, slow from raw cross join ps)"""
_EMAS = X.recurrence("se", "n", "fast, slow, close as f, close as s", "r.fast, r.slow, r.f * (1 - 2e0 / (r.fast + 1)) + n.close * 2e0 / (r.fast + 1), r.s * (1 - 2e0 / (r.slow + 1)) + n.close * 2e0 / (r.slow + 1)", "dn", ", d")
CROSSOVERS = X.signals(f"{X.NUMBERED}, {_EMAS}, q as (select n.*, f, s from n join se on se.symbol = n.symbol and se.ts = n.ts)", *TABLES["ma_crossover"][1:4], "level", None, None, None)
_SPLIT = "split_part(symbol, '#', 1) as symbol, cast(split_part(symbol, '#', 2) as int) as set_id"


@query("sweep_signals", f"+ {CROSSOVERS} select {_SPLIT}, ts, signal from sg", SWEPT)
def _sweep_signals(spark, sf_dir):
    """Three by three settings of a crossover as rows."""
    sets = sweep.parameter_sets(spark, "ma_crossover", SETTINGS)
    return sweep.sweep_signals(S.hourly(spark, sf_dir), sets, "ma_crossover").select("symbol", "set_id", "ts", "signal")


@query("sweep_figures", f"+ {CROSSOVERS}, {X.account()}, {X.METRICS} select * exclude (symbol), {_SPLIT} from mt", SWEPT)
def _sweep_figures(spark, sf_dir):
    """Their back-tests, in one plan."""
    made = sweep.sweep(S.hourly(spark, sf_dir), sweep.parameter_sets(spark, "ma_crossover", SETTINGS), "ma_crossover").drop("place")
    return rounded(made, *(c for c, t in made.dtypes if t == "double"))


@query("compare_failures", """+ s as (select distinct symbol, cast(null as varchar) as error from bars union all select 'ABSENT', 'no bars' union all select 'GAPS', 'volume missing in ' || count(*) || ' bars' from bars where symbol = 'view' and hour(ts) = 3
 union all select 'TWICE', 'times repeated in ' || count(*) || ' bars' from bars where symbol = 'view' and hour(ts) = 5) select s.symbol, n.strategy, s.error
 from s, (values ('awesome_oscillator'), ('orb'), ('buy_and_hold')) as n(strategy)""")
def _failures(spark, sf_dir):
    """A comparison in which some symbols can't be run, and say why; null: it has figures."""
    b = S.hourly(spark, sf_dir)
    view = b.where("symbol = 'view'")
    gaps = view.withColumns({"symbol": F.lit("GAPS"), "volume": F.when(F.hour("ts") != 3, F.col("volume"))})
    twice = view.unionByName(view.where("hour(ts) = 5")).withColumn("symbol", F.lit("TWICE"))
    wanted = b.select("symbol").unionByName(spark.createDataFrame([("ABSENT",)], "symbol string"))
    figures, failed = A.comparison_report(b.unionByName(gaps).unionByName(twice), ("awesome_oscillator", "orb"), wanted=wanted)
    return failed.select("symbol", "strategy", "error").unionByName(figures.select("symbol", "strategy", F.lit(None).cast("string").alias("error")))


THIRTEEN = [n for n in NAMES if n in TABLES]  # all but the one on chart patterns
FEW = ["orb", "volume_momentum", "awesome_oscillator", "macd_crossover"]
#: All fourteen, as SQL says them; a few of them for what only groups folds anew.
ALL_TABLES = TABLES | {"chart_pattern_breakout": f"{Y.patterns()}, {Y.signals()}"}


def compared_sql(names: list[str]) -> str:
    return f"""{X.contest(ALL_TABLES, names, HOURLY)}, al as (select * from mt union all {X.benchmark(HOURLY)}), sp as (select * exclude (symbol, exact), split_part(symbol, '#', 1) as symbol, split_part(symbol, '#', 2) as strategy from al),
 rk as (select *, row_number() over w as k, first_value(case when strategy <> 'buy_and_hold' then sharpe_ratio end) over w as top from sp window w as (partition by symbol order by strategy = 'buy_and_hold', sharpe_ratio desc nulls last, {X.order_of(names)}))
 select * exclude (k, top), case when strategy <> 'buy_and_hold' then k end as rank, round(sharpe_ratio - top, 6) as delta from rk"""


@query("compare_rank", compared_sql(NAMES), bars="+")
def flagship(spark, sf_dir):
    """All strategies back-tested on every symbol and ranked by Sharpe ratio, and the benchmark."""
    return rounded(metrics.ranking(rounded(A.comparison(S.hourly(spark, sf_dir)), *FIGURES), "sharpe_ratio", tuple(NAMES)), "delta")


@query("compare_thirteen", compared_sql(THIRTEEN), bars="+")
def _thirteen(spark, sf_dir):
    """Thirteen strategies and the benchmark, ranked on every symbol."""
    return rounded(metrics.ranking(rounded(A.comparison(S.hourly(spark, sf_dir), tuple(THIRTEEN)), *FIGURES), "sharpe_ratio", tuple(THIRTEEN)), "delta")


# Analysis
REGIME = f"""{X.STRENGTH}, rg as (select bars.symbol, bars.ts, adx, atr / nullif(close, 0) as ap from bars join st using (symbol, ts)), re as (select symbol, ts, case when adx >= median(adx) over (partition by symbol) then 'trending' else 'ranging' end as trend_regime, case when ap >= median(ap) over (partition by symbol) then 'high_vol' else 'low_vol' end as vol_regime from rg)"""
simple("regime", A.classify_regime, ["trend_regime", "vol_regime"], f"+ {REGIME} select * from re")
query("regime_stretches", f"""+ {REGIME}, s0 as (select *, case when (trend_regime, vol_regime) = (lag(trend_regime) over ({W}), lag(vol_regime) over ({W})) then 0 else 1 end as nw from re), s1 as (select *, sum(nw) over ({W} rows unbounded preceding) as stretch from s0)
 select symbol, cast(stretch as bigint) as stretch, trend_regime, vol_regime, min(ts) as from_ts, max(ts) as to_ts, count(*) as bars from s1 group by all""")(lambda spark, sf_dir: A.regime_stretches(A.classify_regime(S.hourly(spark, sf_dir))))
def advised_sql(names: list[str]) -> str:
    return f"""{X.walk(ALL_TABLES, names, HOURLY, REGIME, 10, 5)}, {X.mapped(names)}, nw as (select symbol, arg_max(trend_regime, ts) as trend_regime, arg_max(vol_regime, ts) as vol_regime from (with recursive {HOURLY}, {REGIME} select * from re) group by 1),
 o0 as (select symbol, strategy, avg(exact) as m, count(*) filter (where won) as w from wf group by 1, 2), o1 as (select *, row_number() over (partition by symbol order by m desc, w desc, {X.order_of(names)}) as k from o0 where m is not null)
 select nw.symbol, nw.trend_regime, nw.vol_regime, coalesce(rm.strategy, o1.strategy) as recommended from nw left join rm on rm.symbol = nw.symbol and rm.trend_regime = nw.trend_regime and rm.vol_regime = nw.vol_regime and place = 1 left join o1 on o1.symbol = nw.symbol and k = 1"""


query("walkforward_folds", f"{X.walk(ALL_TABLES, NAMES, HOURLY, REGIME, 10, 5)} select * exclude (exact) from wf", bars="+")(lambda spark, sf_dir: rounded(A.walk_forward(S.hourly(spark, sf_dir), NAMES, 10, 5), *FIGURES))
query("regime_map", f"{X.walk(ALL_TABLES, NAMES, HOURLY, REGIME, 10, 5)}, {X.mapped(NAMES)} select * replace (round(avg_metric, 6) as avg_metric) from rm", bars="+")(lambda spark, sf_dir: rounded(A.regime_map(A.walk_forward(S.hourly(spark, sf_dir), NAMES, 10, 5)), "avg_metric"))
query("recommend", advised_sql(NAMES), bars="+")(lambda spark, sf_dir: A.recommend(A.walk_forward(S.hourly(spark, sf_dir), NAMES, 10, 5), S.hourly(spark, sf_dir)))
query("walkforward_thirteen", f"{X.walk(TABLES, THIRTEEN, HOURLY, REGIME, 10, 5)} select * exclude (exact) from wf", bars="+")(lambda spark, sf_dir: rounded(A.walk_forward(S.hourly(spark, sf_dir), THIRTEEN, 10, 5), *FIGURES))
query("regime_map_few", f"{X.walk(TABLES, FEW, HOURLY, REGIME, 10, 5)}, {X.mapped(FEW)} select * replace (round(avg_metric, 6) as avg_metric) from rm", bars="+")(
    lambda spark, sf_dir: rounded(A.regime_map(A.walk_forward(S.hourly(spark, sf_dir), FEW, 10, 5)), "avg_metric"))
query("recommend_few", advised_sql(FEW), bars="+")(
    lambda spark, sf_dir: A.recommend(A.walk_forward(S.hourly(spark, sf_dir), FEW, 10, 5), S.hourly(spark, sf_dir)))
_UNION = " union all ".join(f"select symbol, ts, close, '{n}' as name, '{d}' as direction, coalesce({PREDICATES[n]}, false) as seen, 100 * {CONFIDENCES[n]} as conf from k" for n, d in candles.DIRECTIONS.items())
_PATTERN_STATS = f"""+ {CANDLES}, l as ({_UNION}), r as (select symbol, ts, lead(close, 10) over ({W}) / nullif(close, 0) - 1 as fr from bars), j as (select l.*, fr, seen and fr is not null as hit from l join r on r.symbol = l.symbol and r.ts = l.ts),
 ps as (select symbol, name, direction, cast(count(*) filter (where hit) as bigint) as occurrences, case direction when 'bullish' then avg(cast(fr > 0 as double)) filter (where hit) when 'bearish' then avg(cast(fr < 0 as double)) filter (where hit) end as win_rate,
 avg(fr) filter (where hit) as avg_forward_return, avg(coalesce(conf, 0)) filter (where hit) as avg_confidence from j group by 1, 2, 3)"""
_ROUNDED = "round(win_rate, 6) as win_rate, round(avg_forward_return, 6) as avg_forward_return, round(avg_confidence, 6) as avg_confidence"


@query("pattern_stats", f"{_PATTERN_STATS} select symbol, name, direction, occurrences, {_ROUNDED} from ps")
def _pattern_stats(spark, sf_dir):
    return rounded(A.pattern_stats(S.hourly(spark, sf_dir)), "win_rate", "avg_forward_return", "avg_confidence")


LONG10 = X.long_table(10, A.SIGNALS)
ALL10, ALL1 = (X.long_table(n, A.SIGNALS, CANDLES, PREDICATES, candles.DIRECTIONS) for n in (10, 1))
query("indicator_stats", f"+ {LONG10}, {X.win_stats('lg', 'symbol')} select symbol, name, direction, occurrences, round(win_rate, 6) as win_rate, round(avg_forward_return, 6) as avg_forward_return from ws")(
    lambda spark, sf_dir: rounded(A.indicator_stats(S.hourly(spark, sf_dir)), "win_rate", "avg_forward_return"))
query("signal_weights", f"+ {LONG10}, {X.win_stats('lg', 'symbol')} select symbol, name, round({X.WEIGHT}, 6) as weight from ws")(
    lambda spark, sf_dir: A.indicator_stats(S.hourly(spark, sf_dir)).withColumn("weight", F.round(A.weight(), 6)).select("symbol", "name", "weight"))
query("composite_score", f"""+ {ALL10}, {X.win_stats('lg', 'symbol')}, wt as (select symbol, name, {X.WEIGHT} as w from ws), la as (select * from (select *, max(ts) over (partition by symbol) as last from lg) where ts = last)
 select symbol, max(ts) as as_of, round(coalesce(avg(w) filter (where seen and w <> 0), 0), 6) as score, count(*) filter (where seen and w <> 0) as contributing from la join wt using (symbol, name) group by 1""")(
    lambda spark, sf_dir: rounded(A.composite_score(S.hourly(spark, sf_dir)), "score"))
query("forecast_folds", f"""+ {ALL1}, dy as (select distinct symbol, cast(ts as date) as day from bars), {X.fold_table(15, 5)}, {X.scored('symbol, ')}, u as (select *, score is not null and fr is not null as used from sc)
 select symbol, fold_id, count(*) as n_test_bars, count(*) filter (where used) as n_predictions, round(count(*) filter (where used) / count(*), 6) as coverage, round(count(*) filter (where used and (score > 0) = (fr > 0)) / nullif(count(*) filter (where used), 0), 6) as hit_rate,
 round(count(*) filter (where used and fr > 0) / nullif(count(*) filter (where used), 0), 6) as baseline_up_rate from u group by grouping sets ((symbol, fold_id), (symbol))""")(
    lambda spark, sf_dir: rounded(A.validate_forecast(S.hourly(spark, sf_dir), 1, 15, 5), "coverage", "hit_rate", "baseline_up_rate"))
query("cross_section_ic", f"""+ ok as (select symbol from bars group by 1 having count(distinct cast(ts as date)) >= 25), ub as (select bars.* from bars semi join ok using (symbol)), un as (select count(distinct symbol) as n from ub), {ALL1}, dy as (select cast(ts as date) as day from ub group by 1 having count(distinct symbol) = (select n from un)), {X.fold_table(15, 5, '')},
 lgx as (select * from lg semi join ok using (symbol)), {X.scored('').replace('from lg ', 'from lgx ')}, al as (select ts from ub group by 1 having count(distinct symbol) = (select n from un)),
 c1 as (select fold_id, ts, fr, coalesce(round(score, 9), 0) as score from sc semi join al using (ts) where fr is not null),
 c2 as (select *, rank() over (partition by fold_id, ts order by score) + (count(*) over (partition by fold_id, ts, score) - 1) / 2.0 as rs, rank() over (partition by fold_id, ts order by fr) + (count(*) over (partition by fold_id, ts, fr) - 1) / 2.0 as rr, median(score) over (partition by fold_id, ts) as med, count(*) over (partition by fold_id, ts) as k from c1),
 cx as (select *, cast(2 * rs - k - 1 as bigint) as x, cast(2 * rr - k - 1 as bigint) as y from c2),
 c3 as (select fold_id, ts, cast(sum(x * y) as double) / nullif(sqrt(cast(sum(x * x) as double) * cast(sum(y * y) as double)), 0) as ic, avg(fr) filter (where score > med) - avg(fr) filter (where score < med) as spread from cx group by 1, 2 having count(*) >= 5 and count(distinct score) >= 2),
 c4 as (select fold_id, count(*) as n_timestamps, round(avg(ic), 6) as mean_ic, round(avg(cast(ic > 0 as double)), 6) as ic_hit_rate, round(avg(spread), 6) as top_minus_bottom_spread from c3 where ic is not null group by grouping sets ((fold_id), ())),
 ev as (select distinct fold_id from fo union all select null) select ev.fold_id, coalesce(n_timestamps, 0) as n_timestamps, mean_ic, ic_hit_rate, top_minus_bottom_spread from ev left join c4 on ev.fold_id is not distinct from c4.fold_id""")(
    lambda spark, sf_dir: rounded(A.validate_cross_section(S.hourly(spark, sf_dir), 1, 15, 5), "mean_ic", "ic_hit_rate", "top_minus_bottom_spread"))
query("snapshot", f"+ {X.gauges()}")(lambda spark, sf_dir: rounded(A.snapshot(S.hourly(spark, sf_dir)), "value", "gauge_pct"))
query("recent_patterns")(lambda spark, sf_dir: rounded(A.recent_patterns(S.daily(spark, sf_dir)), "confidence"))


@query("scan_hits")
def _scan(spark, sf_dir):
    b = S.daily(spark, sf_dir)
    watched = b.select("symbol").distinct().unionByName(spark.createDataFrame([("NONE",)], "symbol string"))
    return A.scan(b, watched)


# Documents
query("period_windows", f"""+ {AO_TABLES}, {X.account()}, {X.EXTREMES}, pb as (select *, row_number() over ({W}) - 1 as i, avg(volume) over (partition by symbol) as mean from bars),
 pe as (select ex.symbol, kind, a.i as a, b.i as b from ex join pb a on a.symbol = ex.symbol and a.ts = from_ts join pb b on b.symbol = ex.symbol and b.ts = to_ts),
 ph as (select pb.*, kind, case when i between a - 10 and a - 1 then 'pre' when i between a and b then 'during' when i between b + 1 and b + 10 then 'post' end as phase from pe join pb using (symbol)),
 pr as (select *, close / nullif(lag(close) over (partition by symbol, kind, phase order by i), 0) - 1 as r from ph where phase is not null),
 pw as (select symbol, kind, phase, min(ts) as start_ts, max(ts) as end_ts, round(arg_max(close, i) / nullif(arg_min(close, i), 0) - 1, 6) as price_change_pct, round(avg(volume), 6) as avg_volume, round(avg(volume) / nullif(any_value(mean), 0), 6) as volume_ratio, round(stddev_samp(r), 6) as volatility, count(*) as num_bars from pr group by 1, 2, 3),
 pa as (select symbol, kind, unnest(['pre', 'during', 'post']) as phase from pe) select pa.*, start_ts, end_ts, price_change_pct, avg_volume, volume_ratio, volatility, coalesce(num_bars, 0) as num_bars from pa left join pw on pw.symbol = pa.symbol and pw.kind = pa.kind and pw.phase = pa.phase""")(lambda spark, sf_dir: rounded(metrics.period_windows(metrics.best_and_worst(B.run(_ao_signals(spark, sf_dir))[0]), S.hourly(spark, sf_dir)), "price_change_pct", "avg_volume", "volume_ratio", "volatility"))
query("symbol_document")(lambda spark, sf_dir: documents.symbol_document(S.hourly(spark, sf_dir)))
query("stats_table", f"{_PATTERN_STATS} select symbol, name, direction, occurrences, {_ROUNDED}, row_number() over (partition by symbol, direction order by coalesce(win_rate, -1) desc, name) as row, occurrences < 5 as low_sample from ps")(lambda spark, sf_dir: rounded(documents.stats_table(A.pattern_stats(S.hourly(spark, sf_dir))), "win_rate", "avg_forward_return", "avg_confidence"))
query("recommendation", f"""{_PATTERN_STATS}, rs as (select symbol, coalesce(sum(case when occurrences > 0 then case direction when 'bullish' then 1 when 'bearish' then -1 end * coalesce(win_rate, 0.5) * coalesce(avg_confidence, 50) / 100 * least(1.0, occurrences / 5.0) end), 0) as score from ps group by 1)
 select symbol, round(score, 6) as score, case when abs(score) < 0.05 then 'mixed' when score > 0 then 'bullish' else 'bearish' end as verdict from rs""")(lambda spark, sf_dir: rounded(documents.recommendation(A.pattern_stats(S.hourly(spark, sf_dir))), "score"))


# Ticks
ASOF = """with t as (select 'EVT' as symbol, ts, value as price, cast(1 + event_id % 5 as double) as size from events where event_type = 'purchase'),
 q as (select 'EVT' as symbol, ts, value * 0.999 as bid_price, value * 1.001 as ask_price, cast(1 + event_id % 7 as double) as bid_size, cast(1 + event_id % 3 as double) as ask_size from events where event_type = 'view'),
 j as (select t.*, (q.bid_price + q.ask_price) / 2 as mid from t asof left join q on t.symbol = q.symbol and t.ts >= q.ts),
 s as (select *, case when sign(price - mid) = 0 then coalesce(sign(price - lag(price) over (order by ts)), 0) else sign(price - mid) end as side from j)"""


@query("asof_trade_side", ASOF + " select symbol, ts, price, round(mid, 6) as mid, cast(side as double) as side from s", "")
def _side(spark, sf_dir):
    return rounded(ticks.classify_side(S.trades(spark, sf_dir), S.quotes(spark, sf_dir)).select("symbol", "ts", "price", "mid", "side"), "mid")


MICRO = ASOF + """, a as (select symbol, time_bucket(interval 15 minutes, ts) as bucket, coalesce(sum(side * size), 0) / nullif(sum(size), 0) as order_flow_imbalance, count(*) as trade_count, arg_max(price, ts) as close from s group by 1, 2),
 b as (select symbol, time_bucket(interval 15 minutes, ts) as bucket, avg((bid_size - ask_size) / nullif(bid_size + ask_size, 0)) as quote_imbalance, avg((ask_price - bid_price) / nullif((ask_price + bid_price) / 2, 0)) as relative_spread, count(*) as quote_count from q group by 1, 2)"""


@query("micro_features", MICRO + " select symbol, bucket, round(order_flow_imbalance, 6) as order_flow_imbalance, trade_count, round(close, 6) as close, round(quote_imbalance, 6) as quote_imbalance, round(relative_spread, 6) as relative_spread, quote_count from a full outer join b using (symbol, bucket)", "")
def _micro(spark, sf_dir):
    f = ticks.features(S.trades(spark, sf_dir), S.quotes(spark, sf_dir)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    return rounded(f, "order_flow_imbalance", "close", "quote_imbalance", "relative_spread")


_IC = MICRO.replace("interval 15 minutes", "interval 6 hours") + """, f as (select * from a full outer join b using (symbol, bucket) where coalesce(trade_count, 0) >= 2 and coalesce(quote_count, 0) >= 2), g as (select *, lead(close) over (partition by symbol order by bucket) / nullif(close, 0) - 1 as r from f),
 l as (select symbol, r, unnest(['order_flow_imbalance', 'quote_imbalance', 'relative_spread']) as feature, unnest([order_flow_imbalance, quote_imbalance, relative_spread]) as value from g), m as (select * from l where r is not null and value is not null), nw as (select symbol, count(*) as n_windows from g where close is not null and r is not null group by 1),
 k as (select *, rank() over (partition by symbol, feature order by value) + (count(*) over (partition by symbol, feature, value) - 1) / 2.0 as x, rank() over (partition by symbol, feature order by r) + (count(*) over (partition by symbol, feature, r) - 1) / 2.0 as y from m)
 select k.symbol, feature, count(*) as n, any_value(n_windows) as n_windows, round(case when count(*) >= 10 then covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) end, 6) as ic from k join nw on nw.symbol = k.symbol group by 1, 2"""
query("micro_ic", _IC, "")(lambda spark, sf_dir: rounded(ticks.validate(S.trades(spark, sf_dir), S.quotes(spark, sf_dir), "6 hours", 1, 2, 2), "ic"))
JOURNAL = """with t as (select o_orderpriority as setup_type, round(o_totalprice - 250000, 2) as net_pl from orders where o_orderstatus = 'F')
 select setup_type, cast(grouping(setup_type) as integer) as is_total, count(*) as trades, count(*) filter (where net_pl > 0) as wins, round(count(*) filter (where net_pl > 0) / count(*), 6) as win_rate, round(avg(net_pl) filter (where net_pl > 0), 4) as avg_win,
 round(avg(net_pl) filter (where net_pl <= 0), 4) as avg_loss, round(coalesce(sum(net_pl) filter (where net_pl > 0), 0) / nullif(abs(sum(net_pl) filter (where net_pl <= 0)), 0), 6) as profit_factor, round(sum(net_pl), 2) as net from t group by grouping sets ((setup_type), ())"""


@query("journal_stats", JOURNAL, "")
def _journal(spark, sf_dir):
    s = journal.stats(S.journal(spark, sf_dir)).drop("no_losses")
    return rounded(rounded(rounded(s, "win_rate", "profit_factor"), "avg_win", "avg_loss", places=4), "net", places=2)


SETUPS = """s as (select o_orderkey as id, case when o_orderkey % 2 = 0 then 'long' else 'short' end as side, o_totalprice as entry_price, o_totalprice * (1 + (o_orderkey % 7 - 4) / 100.0::double) as stop_loss, o_totalprice * (1 + (o_orderkey % 11 - 5) / 50.0::double) as target_price, o_orderkey % 3 = 0 as volume_confirmed, o_orderkey % 5 = 0 as higher_tf_aligned from orders),
 r as (select *, case side when 'long' then entry_price - stop_loss else stop_loss - entry_price end as risk, case side when 'long' then target_price - entry_price else entry_price - target_price end as reward from s),
 c as (select *, case when risk > 0 and reward > 0 then reward / risk end as rr from r)"""


@query("journal_checks", f"""with {SETUPS} select id, round(rr, 6) as rr_ratio, coalesce(risk > 0 and reward > 0 and rr >= 1.5, false) as is_valid, case when risk <= 0 then 'stop loss is not on the losing side of the entry' when reward <= 0 then 'target is not on the winning side of the entry' when rr < 1.5 then 'reward is too small against the risk' end as error,
 cast(volume_confirmed is false as integer) + cast(higher_tf_aligned is false as integer) as n_warnings, case when risk > 0 then cast(floor(200 / risk) as bigint) else 0 end as suggested_quantity from c""", "")
def _checks(spark, sf_dir):
    v = journal.suggested_quantity(journal.validate_setup(S.setups(spark, sf_dir)))
    return rounded(v.select("id", "rr_ratio", "is_valid", F.get("errors", F.lit(0)).alias("error"), F.size("warnings").alias("n_warnings"), "suggested_quantity"), "rr_ratio")


@query("journal_life", """with t as (select o_orderkey as id, case when o_orderkey % 2 = 0 then 'long' else 'short' end as side, o_totalprice as p, o_totalprice * (1 + (o_orderkey % 9 - 4) / 100.0::double) as x, o_orderkey % 4 as k from orders),
 c as (select *, case when k <> 3 then case side when 'long' then 1 else -1 end * (x - p) * 10 end as gross from t)
 select id, 'S' || id % 3 as symbol, side, round(gross, 4) as gross_pl, round(gross - 5, 4) as net_pl, case when k = 2 then 'invalidated' when k = 3 then 'open' when gross - 5 > 0 then 'closed_win' else 'closed_loss' end as status, case when k = 1 then 'checked' else '' end as notes from c""", "")
def _life(spark, sf_dir):
    trades = journal.create(S.setups(spark, sf_dir).withColumns({"symbol": F.concat(F.lit("s"), F.col("id") % 3), "setup_type": F.lit("orb"), "quantity": F.lit(10)}), F.lit("2024-01-02"))
    k = F.col("id") % 4
    trades = journal.close(trades.withColumns({"fees": F.lit(5.0), "exit_price": F.when(k != 3, F.col("entry_price") * (1 + (F.col("id") % 9 - 4) / 100.0))}))
    changes = trades.where(k.isin(1, 2)).select("id", F.lit(1).alias("seq"), F.when(k == 1, "notes").otherwise("invalidate").alias("event"), F.lit("checked").alias("notes"))
    done = journal.export(journal.amend(trades, changes))
    return rounded(done.select("id", "symbol", "side", "gross_pl", "net_pl", "status", "notes"), "gross_pl", "net_pl", places=4)


@query("journal_records", """with t as (select o_orderkey as id, json_object('id', o_orderkey, 'side', case when o_orderkey % 2 = 0 then 'long' else 'short' end, 'status', 'open', 'quantity', o_orderkey % 50, 'more', json_object('clerk', o_orderstatus)) as doc from orders where o_orderkey % 5 <> 4),
 m as (select id, json_merge_patch(doc, case id % 4 when 1 then json_object('notes', 'checked', 'status', 'invalidated') when 2 then json_object('quantity', 7, 'tag', o_orderpriority) else json_object() end) as doc from t join orders on o_orderkey = id)
 select id, json_extract_string(doc, '$.side') as side, json_extract_string(doc, '$.status') as status, cast(json_extract(doc, '$.quantity') as int) as quantity, json_extract_string(doc, '$.notes') as notes, json_extract_string(doc, '$.tag') as tag, json_extract_string(doc, '$.more.clerk') as clerk from m""", "")
def _records(spark, sf_dir):
    """Trades as JSON records: stored, patched, some deleted; fields that are unknown to the journal stay."""
    o, found = S.table(spark, sf_dir, "orders"), records.RecordStore(spark, S.shared_dir(spark))
    k = F.col("o_orderkey")
    lines = o.select(F.to_json(F.struct(k.alias("id"), F.when(k % 2 == 0, "long").otherwise("short").alias("side"), F.lit("open").alias("status"), (k % 50).alias("quantity"), F.struct(F.col("o_orderstatus").alias("clerk")).alias("more"))).alias("value"))
    found.put("trades", records.parsed(lines).withColumn("seq", F.lit(0)))
    patch = F.when(k % 4 == 1, F.to_json(F.struct(F.lit("checked").alias("notes"), F.lit("invalidated").alias("status")))).when(k % 4 == 2, F.to_json(F.struct(F.lit(7).alias("quantity"), F.col("o_orderpriority").alias("tag"))))
    found.put("trades", o.select(k.cast("string").alias("id"), F.lit(1).alias("seq"), F.parse_json(patch).alias("doc")).where("doc is not null"))
    found.delete("trades", o.where(k % 5 == 4).select(k.alias("id")))
    kinds = {"side": "string", "status": "string", "quantity": "int", "notes": "string", "tag": "string"}
    made = records.fields(found.read("trades"), kinds)
    return made.select(F.col("id").cast("long").alias("id"), *kinds, F.try_variant_get("doc", "$.more.clerk", "string").alias("clerk"))


@query("watchlist", """with e as (select upper(trim(event_type)) as symbol, event_id as seq, case when event_id % 11 = 0 then 'remove' else 'add' end as event from events), g as (select *, coalesce(max(case when event = 'remove' then seq end) over (partition by symbol), -1) as gone from e),
 k as (select symbol, min(seq) as first from g where event = 'add' and seq > gone group by 1) select symbol, row_number() over (order by first) as position from k""", "")
def _watchlist(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    return documents.watchlist(e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "remove").otherwise("add").alias("event")))


# Chart patterns
query("swings", f"+ {X.SWINGS} select symbol, cast(swing_no as integer) as swing_no, cast(bar_idx as bigint) as bar_idx, ts, price, kind from sw")(lambda spark, sf_dir: chart.swings(S.hourly(spark, sf_dir)))
# thresholds in per cent of the price, small enough for many swings
query("swings_fine", f"+ {X.SWINGS.replace('coalesce(greatest(300 * median(atr / nullif(close, 0)), 0.5), 3.0) / 100', '0.2::double')} select symbol, cast(swing_no as integer) as swing_no, cast(bar_idx as bigint) as bar_idx, ts, price, kind from sw")(lambda spark, sf_dir: chart.swings(S.hourly(spark, sf_dir), 20.0))
query("chart_patterns")(lambda spark, sf_dir: chart.chart_patterns(S.hourly(spark, sf_dir)))
SMOOTHED = HOURLY.replace("bars as", "raw as", 1) + ", bars as (select symbol, ts, " + ", ".join(f"round(avg({c}) over ({W} rows between 23 preceding and current row), 6) as {c}" for c in frames.OHLCV) + " from raw)"
_SHAPE = "symbol, name, direction, breakout_idx, breakout_time, round(breakout_price, 6) as breakout_price, confidence, n_vertices, cast(place as integer) as place"


def _shapes(bars: DataFrame, percent: float) -> DataFrame:
    made = chart.chart_patterns(bars, percent).withColumn("n_vertices", F.size("vertices"))
    return rounded(made.select("symbol", "name", "direction", "breakout_idx", "breakout_time", "breakout_price", "confidence", "n_vertices", "place"), "breakout_price")


def _smoothed(spark, sf_dir) -> DataFrame:
    """Hourly bars, each the mean of a day's: a series that draws triangles and wedges."""
    b = S.hourly(spark, sf_dir)
    w = last_rows(series(b), 24)
    return b.select("symbol", "ts", *(F.round(F.avg(c).over(w), 6).alias(c) for c in frames.OHLCV))


query("shapes_hourly", f"+ {Y.patterns(40.0)} select {_SHAPE} from ch")(lambda spark, sf_dir: _shapes(S.hourly(spark, sf_dir), 40.0))
query("shapes_smoothed", f"+ {Y.patterns(5.0)} select {_SHAPE} from ch", SMOOTHED)(lambda spark, sf_dir: _shapes(_smoothed(spark, sf_dir), 5.0))
query("shape_stats", f"+ {Y.patterns(5.0)}, {Y.stats()} select symbol, name, direction, occurrences, round(win_rate, 6) as win_rate, round(avg_forward_return, 6) as avg_forward_return, round(avg_confidence, 6) as avg_confidence from cs", SMOOTHED)(
    lambda spark, sf_dir: rounded(chart.chart_pattern_stats(_smoothed(spark, sf_dir), 10, chart.chart_patterns(_smoothed(spark, sf_dir), 5.0)), "win_rate", "avg_forward_return", "avg_confidence"))
query("chart_pattern_stats", f"+ {Y.patterns()}, {Y.stats()} select symbol, name, direction, occurrences, round(win_rate, 6) as win_rate, round(avg_forward_return, 6) as avg_forward_return, round(avg_confidence, 6) as avg_confidence from cs")(lambda spark, sf_dir: rounded(chart.chart_pattern_stats(S.hourly(spark, sf_dir)), "win_rate", "avg_forward_return", "avg_confidence"))


@query("reversal_patterns", f"+ {Y.patterns(40.0)} select symbol, name, direction, breakout_idx, breakout_time, round(breakout_price, 6) as breakout_price, confidence from ch where name in ('head_and_shoulders', 'inverse_head_and_shoulders', 'double_top', 'double_bottom')")
def _reversals(spark, sf_dir):
    """Bars to occurrences by a table function in SQL."""
    table_functions.register(spark)
    made = spark.sql("select * from reversal_patterns(bars => table(select * from {bars}) partition by symbol order by ts, threshold => 40.0)", bars=S.hourly(spark, sf_dir))
    return rounded(made, "breakout_price")


query("trendlines", f"+ {Y.patterns()} select symbol, name, direction, at_ as at, breakout_idx, confidence from bn")(lambda spark, sf_dir: chart.converging(S.hourly(spark, sf_dir), chart.swings(S.hourly(spark, sf_dir))).select("symbol", "name", "direction", "at", "breakout_idx", "confidence"))
query("flags", f"+ {Y.patterns()} select symbol, direction, at_ as at, breakout_idx, confidence from ch where name = 'flag'")(lambda spark, sf_dir: chart.flags(S.hourly(spark, sf_dir)).select("symbol", "direction", "at", "breakout_idx", "confidence"))


@query("stream_ohlcv_batch", """select 'EVT' as symbol, cast(time_bucket(interval 1 hour, ts) as timestamp) as ts, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, sum(cast(1 + event_id % 5 as double)) as volume
 from events where event_type = 'purchase' group by 2""", "")
def _stream(spark, sf_dir):
    return stream.ohlcv(S.trades(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
