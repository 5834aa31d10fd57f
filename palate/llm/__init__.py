"""Training-data operators: deduplication, filtering, search, packing and sharding of large text corpora."""
