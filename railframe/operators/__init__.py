"""Applying types to DataFrames, and the combinators built on them."""
