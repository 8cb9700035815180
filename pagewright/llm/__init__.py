"""Training-data operators: deduplication, filtering, scoring, decontamination, tokenising."""
