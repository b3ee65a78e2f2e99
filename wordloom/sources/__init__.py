"""Readers of the reference tables and of corpora."""
