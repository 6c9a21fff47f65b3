"""Training-data operators: deduplication, filtering, formatting, indexing, mixing and packing."""
