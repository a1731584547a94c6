"""Market time series and training-data analytics on Spark."""
