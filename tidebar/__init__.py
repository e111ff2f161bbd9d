"""Market time series and backtests as Spark plans."""
