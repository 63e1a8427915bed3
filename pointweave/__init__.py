"""Point clouds and the photographs that see them, as Spark DataFrames."""
