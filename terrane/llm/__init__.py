"""Training-data operators: sharding, mixing, de-duplication, filtering, tokens."""
