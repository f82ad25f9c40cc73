"""Training-data operators: tokenising, packing, formatting, filtering, near-duplicates, fingerprints, scoring."""
