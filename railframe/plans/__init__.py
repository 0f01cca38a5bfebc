"""Type expressions, their algebra, and their translation to Columns."""
