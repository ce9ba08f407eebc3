"""foliograph: positioned page text to linked, evaluated tables, as Spark DataFrames."""
