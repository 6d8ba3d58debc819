"""Set-at-a-time operators: DataFrames in, one DataFrame out, no action."""
