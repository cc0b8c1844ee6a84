"""Document-corpus analytics as plain functions from DataFrames to DataFrames."""
