"""Training-data operators: tokenizing, filtering, deduplication, search, packing, formatting."""
