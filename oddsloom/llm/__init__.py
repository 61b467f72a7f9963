"""Training-data operators: scoring, deduplication, mixing, packing and formatting of text corpora."""
