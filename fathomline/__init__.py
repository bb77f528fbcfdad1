"""Maritime spatio-temporal analytics expressed as Spark DataFrames."""
