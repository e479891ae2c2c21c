"""flatewise: compressed byte streams as DataFrames - codec, index, planning, statistics and benchmark results."""
