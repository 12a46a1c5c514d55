"""Statistical post-processing and verification of gridded forecasts on Spark DataFrames."""
