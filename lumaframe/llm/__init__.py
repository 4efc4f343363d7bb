"""Training-data operators: splits, overlaps, neighbours, packing, mixing, sentences."""
