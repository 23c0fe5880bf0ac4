"""Training-data operators: extraction, scoring, deduplication, decontamination, mixing."""
