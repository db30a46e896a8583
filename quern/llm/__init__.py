"""Operators for training data: selection, splits, leaks, mixing, tokens. Nothing outside this package imports it."""
