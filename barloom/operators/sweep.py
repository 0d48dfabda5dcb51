"""Strategies by parameter sets: settings are rows, a set is one more key of a series, and a sweep is one back-test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import keys
from ..functions.tables import materialize
from . import backtest, frames
from . import metrics as M
from .strategies import IN_KERNELS, LENGTHS, REGISTRY, signals

C = F.col
SETS = "strategy string, set_id int, exit_mode string, params map<string,string>"
#: Sets of one strategy in one sweep; they are joined to every series by broadcast.
MOST_SETS = 10_000
KINDS = {int: "int", float: "double", bool: "boolean"}


def catalogue(spark: SparkSession) -> DataFrame:
    """name, title, exit_modes, and params: name, type and default of each setting."""
    rows = [(s.name, s.title, list(s.modes), [(k, KINDS[type(v)], str(v)) for k, v in s.defaults.items()]) for s in REGISTRY.values()]
    return spark.createDataFrame(rows, "name string, title string, exit_modes array<string>, params array<struct<name:string,type:string,default:string>>")


def parameter_sets(spark: SparkSession, strategy: str, settings: list[dict], exit_mode: str | None = None) -> DataFrame:
    """Rows of SETS, numbered from 0."""
    return spark.createDataFrame([(strategy, k, exit_mode, {n: str(v) for n, v in s.items()}) for k, s in enumerate(settings)], SETS)


def typed(sets: DataFrame, strategy: str) -> DataFrame:
    """set_id, exit_mode and a column p_<setting> for each setting of a strategy, typed by its default and that where a set
    doesn't name it. Whole numbers may come as 9.0. Unknown names are passed over; a value that can't be read is an error."""
    if strategy not in REGISTRY:
        raise ValueError(f"unknown strategy {strategy!r}")
    made = {}
    for name, default in REGISTRY[strategy].defaults.items():
        kind = KINDS[type(default)]
        value = C("params")[name].cast("double").cast("int") if kind == "int" else C("params")[name].cast(kind)
        made[f"p_{name}"] = F.coalesce(value, F.lit(default))
    return sets.where(C("strategy") == strategy).select("set_id", "exit_mode", *(v.alias(k) for k, v in made.items()))


def sweep_signals(bars: DataFrame, sets: DataFrame, strategy: str) -> DataFrame:
    """The bars once for each set of the strategy, with set_id and signals. Sets that have the lengths of frames in common, which
    must be literals, are one branch; all other settings are columns."""
    lengths = [f"p_{n}" for n in LENGTHS.get(strategy, ())]
    some = materialize(typed(sets, strategy)).withColumn("_all", F.lit(1))
    branches = some.select("exit_mode", *lengths).distinct().limit(MOST_SETS + 1).collect()
    if some.limit(MOST_SETS + 1).count() > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets of {strategy}")
    out, columns = None, [c for c in bars.columns if c != "set_id"]
    for branch in branches:
        mine = some
        for name, value in branch.asDict().items():
            mine = mine.where(C(name).eqNullSafe(F.lit(value)))
        given = {n: branch[f"p_{n}"] if f"p_{n}" in lengths else f"p_{n}" if n in IN_KERNELS.get(strategy, ()) else C(f"p_{n}") for n in REGISTRY[strategy].defaults}
        each = bars.select(*columns).withColumn("_all", F.lit(1)).join(F.broadcast(mine.drop("exit_mode")), "_all").drop("_all")
        made = signals(each, strategy, branch["exit_mode"], **given).select(*columns, "set_id", "signal", "stop_price", "target_price")
        out = made if out is None else out.unionByName(made)
    return out if out is not None else signals(bars.withColumn("set_id", F.lit(0)).limit(0), strategy)


def sweep(bars: DataFrame, sets: DataFrame, strategy: str, config: backtest.Config = backtest.Config()) -> DataFrame:
    """Figures of each series and set, with `place`: of the sets of a series by Sharpe ratio, then return, then number."""
    frames.check_bars(bars)
    made = materialize(sweep_signals(bars, sets, strategy))
    curve, trades = map(materialize, backtest.run(made, config))
    figures = M.metrics(curve, trades, initial_capital=config.initial_capital)
    from pyspark.sql import Window

    w = Window.partitionBy(*(k for k in keys(figures) if k != "set_id")).orderBy(C("sharpe_ratio").desc_nulls_last(), C("total_return").desc_nulls_last(), "set_id")
    return figures.withColumn("place", F.row_number().over(w))
