"""Training-data operators: scoring, filtering, deduplication, packing and sharding of text corpora."""
