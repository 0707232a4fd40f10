"""Operators of a training-data pipeline: mixing, sharding, search, deduplication, encoding, packing, language and PII."""
