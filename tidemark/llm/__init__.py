"""Training-data operators: packing, deduplication, archives, scoring and mixing."""
