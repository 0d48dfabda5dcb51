"""Table functions against the DataFrame functions that find the same."""

import pytest

from barloom.operators import chart, table_functions
from barloom.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    table_functions.register(spark)
    made = fixtures.hourly(spark, SF)
    made.createOrReplaceTempView("bars_of_test")
    return made


def test_swings_and_reversals(spark, bars):
    got = spark.sql("select * from swing_points(bars => table(bars_of_test) partition by symbol order by ts, threshold => 20.0)")
    want = chart.swings(bars, 20.0).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema == want.schema
    got = spark.sql("select * from reversal_patterns(bars => table(bars_of_test) partition by symbol order by ts, threshold => 40.0)")
    want = chart.chart_patterns(bars, 40.0).where("name rlike 'shoulders|double'").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50


def test_empty_and_short_series(spark, bars):
    for where in ("false", "ts < timestamp_ntz'2024-01-01 01:30:00'"):
        assert spark.sql(f"select * from reversal_patterns(bars => table(select * from bars_of_test where {where}) partition by symbol order by ts, threshold => 5.0)").count() == 0


@pytest.mark.parametrize("call,says", [
    ("swing_points(bars => table(select symbol, ts, high from bars_of_test) partition by symbol order by ts, threshold => 5.0)", "without low"),
    ("swing_points(bars => table(select symbol, ts, 'x' as high, low from bars_of_test) partition by symbol order by ts, threshold => 5.0)", "no numbers in high"),
    ("swing_points(bars => table(bars_of_test) partition by symbol order by ts, threshold => -1.0)", "above 0"),
    ("swing_points(bars => 1, threshold => 5.0)", "first argument is a table"),
])
def test_arguments_are_checked(spark, bars, call, says):
    with pytest.raises(Exception, match=says):
        spark.sql(f"select * from {call}").collect()
