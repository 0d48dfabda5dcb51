"""Detectors as table functions, so that SQL turns bars into occurrences:

    select * from reversal_patterns(bars => table(bars) partition by symbol order by ts, threshold => 5.0)

A partition is one series in order of time. What they find equals the DataFrame functions of `chart`.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.udtf import UserDefinedTableFunction

from .chart import AHEAD, NAMES, _zigzag

KINDS = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}  # analyze() has no session to parse types with


def result(columns: str, bars: AnalyzeArgument, threshold: AnalyzeArgument, needed: tuple[str, ...]) -> AnalyzeResult:
    """The schema, if the arguments are a table that has what is needed and a constant above 0; the series' name is the first column."""
    if not bars.isTable:
        raise ValueError("the first argument is a table: table(bars) partition by symbol order by ts")
    kinds = {f.name: f.dataType for f in bars.dataType.fields}
    missing = [c for c in ("symbol", "ts", *needed) if c not in kinds]
    if missing:
        raise ValueError(f"bars without {', '.join(missing)}")
    odd = [c for c in needed if not isinstance(kinds[c], T.NumericType)]
    if odd:
        raise ValueError(f"no numbers in {', '.join(odd)}")
    if not threshold.isConstantExpression or threshold.value is None or not float(threshold.value) > 0:
        raise ValueError("the threshold is a constant number of per cent above 0")
    of = KINDS | {"time": kinds["ts"]}
    return AnalyzeResult(T.StructType([T.StructField("symbol", kinds["symbol"]), *(T.StructField(n, of[k]) for n, k in map(str.split, columns.split(", ")))]))


class _Series:
    """Collects a partition's rows."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.threshold = 0.0

    def eval(self, bars, threshold) -> None:
        """One row; calls name it so."""
        self.threshold = float(threshold)
        self.rows.append((bars["symbol"], bars["ts"], float(bars["high"]), float(bars["low"]), float(bars["close"]) if "close" in bars else 0.0))

    def swings(self) -> list[tuple[int, float, str]]:
        _, _, high, low, _ = zip(*self.rows, strict=True)
        return _zigzag(np.array(high), np.array(low), self.threshold)


class SwingPoints(_Series):
    @staticmethod
    def analyze(bars: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        return result("swing_no int, bar_idx long, ts time, price double, kind string", bars, threshold, ("high", "low"))

    def terminate(self) -> Iterator[tuple]:
        for k, (at, price, kind) in enumerate(self.swings() if self.rows else ()):
            yield self.rows[at][0], k, at, self.rows[at][1], price, kind


def half_even(x: float) -> float:
    return float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_EVEN))


class ReversalPatterns(_Series):
    @staticmethod
    def analyze(bars: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        return result("name string, direction string, breakout_idx long, breakout_time time, breakout_price double, confidence double", bars, threshold, ("high", "low", "close"))

    def candidates(self, found: list[tuple[int, float, str]]) -> Iterator[tuple]:
        """name, direction, the bar after which the line is to be broken, the line's ends (bar, price), confidence."""
        for k, (_, _, kind) in enumerate(found):
            side = 1 if kind == "high" else -1
            direction, shift = ("bearish", 0) if side > 0 else ("bullish", 1)
            p, i, y = [side * s[1] for s in found[k : k + 5]], [s[0] for s in found[k : k + 5]], [s[1] for s in found[k : k + 5]]
            if len(p) == 5:
                height, uneven, above = p[2] - min(p[1], p[3]), abs(p[0] - p[4]), p[2] - max(p[0], p[4])
                if above > 0 and height > 0 and uneven <= 0.5 * height and above >= 0.1 * height:
                    score = 100 * (0.5 * max(0.0, 1 - uneven / (0.5 * height)) + 0.5 * min(1.0, above / height / 0.3))
                    yield NAMES[shift], direction, i[4], (i[1], y[1]), (i[3], y[3]), half_even(score)
            if len(p) >= 3:
                height, uneven = p[0] - p[1], abs(p[0] - p[2])
                if height > 0 and uneven <= 0.15 * height:
                    yield NAMES[2 + shift], direction, i[2], (i[1], y[1]), (i[2], y[1]), half_even(100 * max(0.0, 1 - uneven / (0.15 * height)))

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        times = np.array([r[1] for r in self.rows], "datetime64[us]").astype(np.int64)
        for name, direction, at, (a, ya), (b, yb), score in self.candidates(self.swings()):
            for k in range(at + 1, min(at + 1 + AHEAD, len(self.rows))):
                line = ya + (times[k] - times[a]) / (times[b] - times[a]) * (yb - ya) if times[b] != times[a] else yb
                if self.rows[k][4] > line if direction == "bullish" else self.rows[k][4] < line:
                    yield self.rows[k][0], name, direction, k, self.rows[k][1], self.rows[k][4], score
                    break


def register(spark: SparkSession) -> None:
    """swing_points(table, threshold) and reversal_patterns(table, threshold), for SQL in this session."""
    for name, cls in (("swing_points", SwingPoints), ("reversal_patterns", ReversalPatterns)):
        spark.udtf.register(name, UserDefinedTableFunction(cls, returnType=None, name=name))
