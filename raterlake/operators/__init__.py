"""Operators over ratings: each takes and returns DataFrames."""
