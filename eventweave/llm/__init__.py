"""Training-data operators: quality scoring, tokenised output, packing, sharding, search and deduplication."""
