"""Relational operators: DataFrames in, DataFrame out, nothing collected to the driver."""
