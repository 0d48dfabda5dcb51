"""The trade journal: checks of a setup, position size, an event log with the latest state, and its rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

C = F.col


#: The columns of an exported journal.
EXPORTED = ("id", "symbol", "setup_type", "side", "entry_price", "stop_loss", "target_price", "quantity", "volume_confirmed", "higher_tf_aligned",
            "rr_ratio", "exit_price", "fees", "gross_pl", "net_pl", "status", "entry_timestamp", "exit_timestamp", "notes")


def at_risk() -> Column:
    """What a share loses at the stop: positive where the stop is on the losing side of the entry."""
    return F.when(C("side") == "long", C("entry_price") - C("stop_loss")).when(C("side") == "short", C("stop_loss") - C("entry_price"))


def validate_setup(setups: DataFrame, least_rr: float = 1.5) -> DataFrame:
    """is_valid, rr_ratio, errors (they block) and warnings of setups with side, entry_price, stop_loss, target_price and, if
    they have them, volume_confirmed and higher_tf_aligned. A misplaced stop hides what else is wrong, and a misplaced target
    the ratio; missing prices and sides are errors."""
    reward = F.when(C("side") == "long", C("target_price") - C("entry_price")).otherwise(C("entry_price") - C("target_price"))
    df = setups.withColumns({"_risk": at_risk(), "_reward": reward})
    df = df.withColumn("rr_ratio", F.when((C("_risk") > 0) & (C("_reward") > 0), ratio("_reward", "_risk")))
    error = (
        F.when(~F.coalesce(C("side").isin("long", "short"), F.lit(False)), "side must be long or short").when(C("_risk").isNull() | C("_reward").isNull(), "a price is missing")
        .when(C("_risk") <= 0, "stop loss is not on the losing side of the entry").when(C("_reward") <= 0, "target is not on the winning side of the entry")
        .when(C("rr_ratio") < least_rr, "reward is too small against the risk")
    )
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    missing = lambda c: ~F.coalesce(C(c), F.lit(False)) if c in setups.columns else F.lit(True)
    warnings = some(F.when(missing("volume_confirmed"), "volume is not confirmed"), F.when(missing("higher_tf_aligned"), "higher time frame is not aligned"))
    return df.withColumns({"is_valid": error.isNull(), "errors": some(error), "warnings": warnings}).drop("_risk", "_reward")


def suggested_quantity(setups: DataFrame, balance: float = 10_000.0, risk_pct: float = 2.0) -> DataFrame:
    """Shares that lose `risk_pct` of the balance at the stop; none where the stop is not on the losing side."""
    size = F.when(at_risk() > 0, F.floor(ratio(F.lit(balance * risk_pct / 100), at_risk())))
    return setups.withColumn("suggested_quantity", F.coalesce(size, F.lit(0)).cast("long"))


def create(setups: DataFrame, at: Column, least_rr: float = 1.5) -> DataFrame:
    """New open trades of setups with id, entered at `at`: symbols in upper case, rr_ratio as validated, nothing closed. A
    setup that isn't valid makes a trade too; the check is a reading, as is the quantity."""
    checked = validate_setup(setups, least_rr)
    none = {"exit_price": "double", "gross_pl": "double", "net_pl": "double"}
    made = checked.withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {
        "symbol": F.upper("symbol"), "fees": F.lit(0.0), "status": F.lit("open"), "entry_timestamp": at.cast("string"), "exit_timestamp": F.lit(None).cast("string"),
    })
    for c, default in (("volume_confirmed", F.lit(False)), ("higher_tf_aligned", F.lit(False)), ("notes", F.lit(""))):
        made = made.withColumn(c, F.coalesce(C(c), default) if c in setups.columns else default)
    return made.select(*EXPORTED)


def amend(trades: DataFrame, changes: DataFrame) -> DataFrame:
    """Trades with `changes` (id, event `notes` or `invalidate`, notes) applied, an id's changes in order of seq: the last notes
    count, and an invalidated trade stays so. Changes to unknown ids do nothing."""
    last = changes.groupBy("id").agg(
        F.max_by("notes", F.when(C("event") == "notes", C("seq"))).alias("_notes"), F.max(C("event") == "notes").alias("_noted"), F.max(C("event") == "invalidate").alias("_gone"),
    )
    j = trades.join(last, "id", "left")
    return j.withColumns({"notes": F.when(C("_noted"), C("_notes")).otherwise(C("notes")), "status": F.when(C("_gone"), "invalidated").otherwise(C("status"))}).select(*trades.columns)


def export(trades: DataFrame) -> DataFrame:
    """The columns of an exported journal, the latest entry first."""
    return trades.select(*(C(c) if c in trades.columns else F.lit(None).alias(c) for c in EXPORTED)).orderBy(F.desc("entry_timestamp"), "id")


def latest(events: DataFrame) -> DataFrame:
    """The state of each id after its last event (seq); deleted ones are gone."""
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    return events.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 and event <> 'delete'").drop("_rn")


def close(trades: DataFrame) -> DataFrame:
    """gross_pl, net_pl and status of trades that have an exit price; a trade wins if it nets more than nothing."""
    gross = F.when(C("side") == "long", 1).otherwise(-1) * (C("exit_price") - C("entry_price")) * C("quantity")
    df = trades.withColumn("gross_pl", gross).withColumn("net_pl", C("gross_pl") - F.coalesce("fees", F.lit(0.0)))
    return df.withColumn("status", F.when(C("exit_price").isNull(), C("status")).when(C("net_pl") > 0, "closed_win").otherwise("closed_loss"))


def select_trades(trades: DataFrame, symbol: str | None = None, setup_type: str | None = None, status: str | None = None, from_date: str | None = None, to_date: str | None = None) -> DataFrame:
    day = F.substring(C("entry_timestamp").cast("string"), 1, 10)
    for c, v in (("symbol", symbol.upper() if symbol else None), ("setup_type", setup_type), ("status", status)):
        trades = trades.where(C(c) == v) if v is not None else trades
    trades = trades.where(day >= from_date) if from_date else trades
    trades = trades.where(day <= to_date) if to_date else trades
    return trades.orderBy(F.desc("entry_timestamp"))


def stats(trades: DataFrame) -> DataFrame:
    """By setup type and over all (setup_type null): only closed trades that know their result. profit_factor is null where nothing was lost;
    no_losses tells that apart from no trades."""
    closed = trades.where(C("status").isin("closed_win", "closed_loss") & C("net_pl").isNotNull())
    win = C("net_pl") > 0
    won, lost = F.sum(F.when(win, C("net_pl"))), F.sum(F.when(~win, C("net_pl")))
    return closed.groupingSets([["setup_type"], []], "setup_type").agg(
        F.grouping("setup_type").cast("int").alias("is_total"), F.count("*").alias("trades"), F.count_if(win).alias("wins"), ratio(F.count_if(win), F.count("*")).alias("win_rate"),
        F.avg(F.when(win, C("net_pl"))).alias("avg_win"), F.avg(F.when(~win, C("net_pl"))).alias("avg_loss"), ratio(F.coalesce(won, F.lit(0.0)), F.abs(lost)).alias("profit_factor"),
        (F.coalesce(lost, F.lit(0.0)) == 0).alias("no_losses"), F.sum("net_pl").alias("net"),
    )
