"""Training-data operators: dedup, filtering, mixing, packing and token output at cluster scale."""
