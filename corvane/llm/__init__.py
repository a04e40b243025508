"""Operators of a training-data pipeline: packing, mixing, sharding, fingerprints, dedup, PII, token counts, quality."""
