"""Operators for large text corpora: each module holds one operator, `queries` the registered queries."""
