"""Training-data operators: tokenising, filtering, deduplication, packing and search over document tables."""
