"""From graph patterns to DataFrames."""
