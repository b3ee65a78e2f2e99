"""Operators for preparing language-model training data; nothing outside imports them."""
