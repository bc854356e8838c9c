"""Set-at-a-time operators: each takes DataFrames and returns a lazy DataFrame."""
