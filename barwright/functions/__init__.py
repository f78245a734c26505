"""Market time series on Spark."""
