"""Training-data operators: dedup, tokenising, scoring, archives, extraction."""
