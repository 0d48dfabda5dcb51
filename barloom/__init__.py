"""Market time-series analytics and strategy back-testing on Spark DataFrames."""
