"""Analytics over tagged documents and append-only change logs, on Spark DataFrames."""
