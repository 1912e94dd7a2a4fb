"""Motion, orientation and location time series as Spark DataFrames."""
