"""Table operators: each takes DataFrames and returns DataFrames (or a dict of them)."""
