"""Training-data operators: decontamination, deduplication, scoring, language ID, packing, search, PII, sharding."""
