"""Null-safe column arithmetic. Nulls stand for missing values; NaN never does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Columns that tell one series from another, where a table has them.
KEYS = ("symbol", "interval", "fold_id", "strategy", "set_id")


def keys(df: DataFrame) -> list[str]:
    return [k for k in KEYS if k in df.columns]


def series(df: DataFrame, *more: str) -> WindowSpec:
    """A window over each series in order of time."""
    return Window.partitionBy(*keys(df), *more).orderBy("ts")


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def last_rows(w: WindowSpec, n: int, end: int = 0) -> WindowSpec:
    return w.rowsBetween(end - n + 1, end)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def rolling(of, c: Column | str, w: WindowSpec, n: int, least: int | None = None, end: int = 0) -> Column:
    """An aggregate over the last n rows, null unless `least` (n) of them have a value."""
    frame = last_rows(w, n, end)
    return F.when(F.count(col(c)).over(frame) >= (n if least is None else least), of(col(c)).over(frame))


def ramp(c: Column, low: float, high: float) -> Column:
    """0 below `low`, 1 above `high`, a line between; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - low) / (high - low))))


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, null where either side is constant; only rows that have both count."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(c: Column, within: list) -> Column:
    """Ranks from 1, ties sharing their mean; null for null."""
    w = Window.partitionBy(*within, c.isNull())
    return F.when(c.isNotNull(), F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*within, c)) - 1) / F.lit(2.0))


def rank_correlation(r: Column, s: Column, k: Column) -> Column:
    """Pearson's of two ranks, each of all k rows of a group. Twice the distance of a rank from its mean is a whole number, so
    sums are exact, and so is the sign, in whatever order rows come. Null where either side is constant."""
    x, y = ((2 * c - (k + 1)).cast("long") for c in (r, s))
    return F.try_divide(F.sum(x * y).cast("double"), F.sqrt(F.sum(x * x).cast("double") * F.sum(y * y).cast("double")))
