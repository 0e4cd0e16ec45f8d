"""Operators for large training-data pipelines: deduplication, scans, quality, mixing, media and tokens."""
