"""The relational operators, as functions from DataFrames to DataFrames."""
