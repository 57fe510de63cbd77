"""Training-data operators: deduplication, packing, filtering and encoding of corpora."""
