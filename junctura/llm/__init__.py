"""Training-data operators: quality, fingerprints, deduplication, language, PII, mixing, sharding, formatting."""
