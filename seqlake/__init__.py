"""seqlake: event, token and signal sequences as Spark DataFrames."""
