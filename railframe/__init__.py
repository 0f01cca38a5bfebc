"""Typed validation, coercion and encoding of DataFrames."""
