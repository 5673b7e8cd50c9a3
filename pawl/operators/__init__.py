"""Relational operators of the ratchet: DataFrames in, DataFrames out."""
