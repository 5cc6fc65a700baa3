"""Training-data operators: sharding, fingerprints, deduplication, packing, mixing, search, toxicity, archives, URL filters."""
