"""Training-data operators: deduplication, scans, classifiers, mixing, tokens and packing."""
