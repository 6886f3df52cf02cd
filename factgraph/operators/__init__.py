"""Operators on DataFrames of the graph: each takes and returns DataFrames."""
