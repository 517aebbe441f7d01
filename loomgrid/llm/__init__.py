"""Training-data operators: quality, deduplication, mixing, sharding and their queries."""
