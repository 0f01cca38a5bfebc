"""Scalar functions: conversions with the reference's texts and truncation, attributes and named methods."""
