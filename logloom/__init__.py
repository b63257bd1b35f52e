"""Log analytics on Spark: read, detect, parse, filter, classify, report, export and follow logs as DataFrames."""
