"""Table-level operators, each a function from DataFrames to DataFrames."""
