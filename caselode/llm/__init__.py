"""Training-data operators: filtering, deduplication, scoring, packing, search."""
