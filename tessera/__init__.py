"""tessera: panel, time-series and tabular analytics declared on Spark DataFrames."""
