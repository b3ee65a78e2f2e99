"""Operators on DataFrames: tokens, resolution of words, conversion, statistics."""
