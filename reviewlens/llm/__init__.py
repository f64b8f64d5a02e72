"""Training-data operators: tokenising, scanning, near-duplicates, classifiers, mixing, rollups and exact search."""
