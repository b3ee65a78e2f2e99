"""Whole queries over the tables."""
