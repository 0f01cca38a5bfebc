"""Types on streams: the same projections and filters as in batches, without state."""
