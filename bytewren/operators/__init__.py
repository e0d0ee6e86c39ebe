"""Operators over byte, bit, token and vector streams; each takes and returns DataFrames."""
