"""Container files as DataFrames."""
