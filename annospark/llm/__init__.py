"""Training-data operators: deduplication, sharding, filtering, tokenising, mixing, vector search."""
