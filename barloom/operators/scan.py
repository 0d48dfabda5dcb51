"""Recurrences over series that are cut by time, so that no task holds more of a series than a slice of it.

What a slice's rows do to the state before them is one map: an affine one of the last value for an exponential mean, one of
three states for a position. A slice is summed up to its map, a row for each slice; the maps of a series are composed in order,
which tells each slice the state before it; then all slices are worked through at once. Slices are calendar units, as
date_trunc names them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import keys
from ..functions.tables import materialize
from . import kernels as K

C = F.col
SLICE = "quarter"
MAP = "k int, rows long, seen long, lead long, trail long, alpha double, first double, a double, b double"
BEFORE = "k int, y double, gap long, seen long"


def sliced(df: DataFrame, slice_: str = SLICE, **columns: Column) -> DataFrame:
    """The rows, stored, with their slice in `_slice`, and with `columns`."""
    return materialize(df.withColumns({"_slice": F.date_trunc(slice_, "ts").cast(df.schema["ts"].dataType), **columns}))


def schema_of(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in columns), *T._parse_datatype_string(more).fields])


def same(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on which null keys are equal, with the columns of `a` and those that only `b` has."""
    a, b = a.alias("a"), b.alias("b")
    return a.join(b, reduce(lambda x, y: x & y, (C(f"a.{c}").eqNullSafe(C(f"b.{c}")) for c in on)), how).select("a.*", *(f"b.{c}" for c in b.columns if c not in on))


def before(df: DataFrame, **columns: str) -> DataFrame:
    """Of sliced rows: each column of the row before in the series, under a new name (name: column). Only the last row of a
    slice is told to the next one."""
    per = keys(df)
    ends = df.groupBy(*per, "_slice").agg(F.max_by(F.struct(*(C(c).alias(n) for n, c in columns.items())), "ts").alias("_end"))
    ends = ends.select(*per, "_slice", F.lag("_end").over(Window.partitionBy(*per).orderBy(C("_slice").asc_nulls_last())).alias("_end"))
    w = Window.partitionBy(*per, "_slice").orderBy("ts")
    first = F.row_number().over(w) == 1
    df = df.withColumns({"_first": first, **{n: F.lag(c).over(w) for n, c in columns.items()}})
    df = same(df, ends, [*per, "_slice"])
    return df.withColumns({n: F.when(C("_first"), C("_end")[n]).otherwise(C(n)) for n in columns}).drop("_first", "_end")


def composed(maps: DataFrame, per: list[str], run, told: str) -> DataFrame:
    """What comes before each slice: `run` gets the maps of one series (and of one mean) in order of slices."""
    by = [*per, *(["k"] if "k" in maps.columns else [])]
    keep = [*per, "_slice"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice", kind="stable").reset_index(drop=True)
        return pd.concat([pdf[keep], run(pdf)], axis=1)

    return maps.groupBy(*by).applyInPandas(work, schema_of(maps, keep, told))


def exponential_means(df: DataFrame, made: dict[str, tuple[str, float | Column, int]]) -> DataFrame:
    """Of sliced rows: exponential means (name: (column, weight of a new value, values needed)) as `kernels.smooth` defines them.

    A missing value keeps the mean, and lets what came before weigh less against the next one. Weights may be columns that
    are constant in a series. A series without values, and rows before the least number of them, get null.
    """
    per, names = keys(df), list(made)
    columns, needed = [made[n][0] for n in names], [max(made[n][2], 1) for n in names]
    weights = {f"_alpha{k}": F.lit(made[n][1]) if isinstance(made[n][1], float) else made[n][1] for k, n in enumerate(names)}
    df = df.withColumns({c: w.cast("double") for c, w in weights.items()})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        rows = []
        for k, c in enumerate(columns):
            x, alpha = pdf[c].astype(float), float(pdf[f"_alpha{k}"].iloc[0])
            at = np.flatnonzero(x.notna().to_numpy())
            if not len(at):
                rows.append((k, len(x), 0, len(x), len(x), alpha, None, 1.0, 0.0))
                continue
            impulse, rest = x.iloc[at[0] :] * 0.0, x.iloc[at[0] :].copy()  # the mean is a multiple of its start and a rest
            impulse.iloc[0], rest.iloc[0] = 1.0, 0.0
            a, b = (float(K.smooth(s, alpha=alpha).iloc[-1]) for s in (impulse, rest))
            rows.append((k, len(x), len(at), int(at[0]), int(len(x) - 1 - at[-1]), alpha, float(x.iloc[at[0]]), a, b))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in MAP.split(", ")])
        return pd.concat([pdf[[*per, "_slice"]].iloc[[0] * len(out)].reset_index(drop=True), out], axis=1)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        y, gap, seen, out = None, 0, 0, []
        for m in pdf.itertuples():
            out.append((m.k, y, gap, seen))
            if m.seen:
                y = m.a * start(y, gap + m.lead, m.first, m.alpha) + m.b
                gap, seen = m.trail, seen + m.seen
            else:
                gap += m.rows
        return pd.DataFrame(out, columns=["k", "y", "gap", "seen"])

    def start(y: float | None, gap: int, x: float, alpha: float) -> float:
        """The mean after the first value of a slice, with `gap` missing ones before it."""
        if y is None or y != y:
            return x
        old = (1 - alpha) ** (gap + 1)
        return (old * y + alpha * x) / (old + alpha)

    def finish(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        for t in told.itertuples():
            x, alpha = pdf[columns[t.k]].astype(float), float(pdf[f"_alpha{t.k}"].iloc[0])
            at, y = np.flatnonzero(x.notna().to_numpy()), None if t.y != t.y else t.y
            if len(at):
                x.iloc[at[0]] = start(y, int(t.gap) + int(at[0]), float(x.iloc[at[0]]), alpha)
            mean = K.smooth(x, alpha=alpha)
            if y is not None:
                mean.iloc[: at[0] if len(at) else len(x)] = y
            pdf[names[t.k]] = mean.where(int(t.seen) + x.notna().cumsum() >= needed[t.k])
        return pdf[out.names]

    narrow = df.select(*dict.fromkeys([*per, "_slice", "ts", *columns, *weights]))
    maps = materialize(narrow.groupBy(*per, "_slice").applyInPandas(summed, schema_of(narrow, [*per, "_slice"], MAP)))
    told = composed(maps, per, compose, BEFORE)
    kept = [c for c in df.columns if c not in weights and c not in names]
    out = schema_of(df, kept, ", ".join(f"`{n}` double" for n in names))
    both = df.groupBy(*per, "_slice").cogroup(told.groupBy(*per, "_slice")).applyInPandas(finish, out)
    none = F.lit(None).cast("double")
    return both.withColumns({n: F.nanvl(n, none) for n in names})


def ema(bars: DataFrame, span: int, of: str, name: str, slice_: str) -> DataFrame:
    rows = sliced(bars, slice_, _of=C(of).cast("double"))
    return exponential_means(rows, {name: ("_of", 2.0 / (span + 1), 0)}).drop("_of", "_slice")


def rsi(bars: DataFrame, period: int, slice_: str) -> DataFrame:
    rows = before(sliced(bars, slice_), _pc="close")
    change, zero = C("close") - C("_pc"), F.lit(0.0)
    rows = rows.withColumns({"_up": F.when(change.isNotNull(), F.greatest(change, zero)), "_down": F.when(change.isNotNull(), F.greatest(-change, zero))})
    weight = 1.0 / period
    made = exponential_means(rows, {"_g": ("_up", weight, period), "_l": ("_down", weight, period)})
    value = 100 - 100 / (1 + C("_g") / F.nullif("_l", zero))
    return made.withColumn("rsi", F.coalesce(value, F.lit(50.0))).drop("_pc", "_up", "_down", "_g", "_l", "_slice")


def adx(bars: DataFrame, period: int, slice_: str) -> DataFrame:
    """`atr` and `adx`."""
    rows = before(sliced(bars, slice_), _pc="close", _ph="high", _pw="low")
    up, down, zero, weight = C("high") - C("_ph"), C("_pw") - C("low"), F.lit(0.0), 1.0 / period
    rows = rows.withColumns({
        "_tr": F.greatest(C("high") - C("low"), F.abs(C("high") - C("_pc")), F.abs(C("low") - C("_pc"))),
        "_up": F.when((up > down) & (up > 0), up).otherwise(zero), "_down": F.when((down > up) & (down > 0), down).otherwise(zero),
    })
    rows = exponential_means(rows, {"atr": ("_tr", weight, period), "_p": ("_up", weight, period), "_m": ("_down", weight, period)})
    plus, minus = (100 * C(c) / F.nullif("atr", zero) for c in ("_p", "_m"))
    rows = materialize(rows.withColumn("_dx", 100 * F.abs(plus - minus) / F.nullif(plus + minus, zero)))
    made = exponential_means(rows, {"adx": ("_dx", weight, period)})
    return made.withColumn("adx", F.coalesce("adx", zero)).drop("_pc", "_ph", "_pw", "_tr", "_up", "_down", "_p", "_m", "_dx", "_slice")


def positions(df: DataFrame, slice_: str = SLICE) -> DataFrame:
    """`signal` of rows with the flags _el, _es, _xl, _xs, as `kernels.hold` defines it."""
    per, rows = keys(df), sliced(df, slice_)
    keep = [*per, "_slice"]

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        found = {n: [int(K.hold(pdf, s)[-1])] for n, s in (("short", -1), ("flat", 0), ("long", 1))}
        return pd.concat([pdf[keep].iloc[:1], pd.DataFrame(found)], axis=1)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = 0, []
        for m in pdf.itertuples():
            out.append(state)
            state = (m.flat, m.long, m.short)[state]
        return pd.DataFrame({"state": out})

    def finish(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        return pdf.drop(columns="_slice").assign(signal=K.hold(pdf, int(told["state"].iloc[0])))

    narrow = rows.select(*keep, "ts", "_el", "_es", "_xl", "_xs")
    maps = materialize(narrow.groupBy(*keep).applyInPandas(ends, schema_of(rows, keep, "short int, flat int, long int")))
    told = composed(maps, per, compose, "state int")
    out = schema_of(rows, [c for c in rows.columns if c not in ("_slice", "signal")], "signal int")
    return rows.drop("signal").groupBy(*keep).cogroup(told.groupBy(*keep)).applyInPandas(finish, out)


def ranks_so_far(df: DataFrame, of: str, name: str, slice_: str = SLICE) -> DataFrame:
    """`name`: how many earlier rows of the series have a smaller value in `of`; 0 where it is null.

    Values are also dealt to bins by range, ties by time. Earlier rows in lower bins are those of earlier slices, which a table
    of counts by slice and bin tells, and those of the own slice; earlier ones in the own bin are found there. Both count equal
    values as well, and those, counted by slice and value, are taken off. Rows have a time each.
    """
    per = keys(df)
    value = F.nanvl(C(of).cast("double"), F.lit(None).cast("double"))
    df = df.withColumns({"_v": value, "_slice": F.date_trunc(slice_, "ts").cast(df.schema["ts"].dataType)})
    rows = materialize(df.repartitionByRange(*(C(c) for c in [*per, "_v", "ts"])).withColumn("_bin", F.spark_partition_id()))
    some = rows.where("_v is not null")

    def lower(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of earlier slices in lower bins, for each slice and bin that has rows."""
        table = pdf.pivot_table(index="_slice", columns="_bin", values="n", aggfunc="sum", fill_value=0)
        sums = np.zeros((len(table) + 1, table.shape[1] + 1), np.int64)
        sums[1:, 1:] = table.to_numpy().cumsum(0).cumsum(1)
        return pdf.assign(_lower=sums[table.index.get_indexer(pdf["_slice"]), table.columns.get_indexer(pdf["_bin"])]).drop(columns="n")

    counts = some.groupBy(*per, "_slice", "_bin").agg(F.count("*").alias("n"))
    counts = counts.groupBy(*per).applyInPandas(lower, schema_of(counts, [*per, "_slice", "_bin"], "_lower long"))
    w = Window.partitionBy(*per, "_v").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    equal = some.groupBy(*per, "_slice", "_v").agg(F.count("*").alias("n"))
    equal = equal.select(*per, "_slice", "_v", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_equal"))

    def add(part: DataFrame, by: str, new: str, run) -> DataFrame:
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
            return pdf.assign(**{new: run(pdf)})

        return part.groupBy(*per, by).applyInPandas(work, schema_of(part, part.columns, f"{new} long"))

    # the number of earlier rows that are no larger is that of all earlier ones but the larger
    made = add(some, "_slice", "_here", lambda p: K.running_rank(p["_bin"].to_numpy(float)))
    made = add(made, "_bin", "_near", lambda p: np.arange(len(p)) - K.running_rank(-p["_v"].to_numpy(float)))
    made = made.withColumn("_twin", F.row_number().over(Window.partitionBy(*per, "_slice", "_v").orderBy("ts")) - 1)
    made = same(same(made, counts, [*per, "_slice", "_bin"]), equal, [*per, "_slice", "_v"])
    made = made.withColumn(name, C("_lower") + C("_here") + C("_near") - C("_equal") - C("_twin"))
    made = made.unionByName(rows.where("_v is null").withColumn(name, F.lit(0).cast("long")), allowMissingColumns=True)
    return made.drop("_v", "_slice", "_bin", "_lower", "_here", "_near", "_equal", "_twin")
