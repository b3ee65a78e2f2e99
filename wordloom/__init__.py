"""Spark-first text engine: orthography conversion, corpus statistics and their building blocks."""
