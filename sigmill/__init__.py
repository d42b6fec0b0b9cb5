"""Analytics on industrial sensor signals, as Spark DataFrames keyed by series."""
