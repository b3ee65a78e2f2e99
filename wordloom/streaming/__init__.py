"""Conversion of streams."""
