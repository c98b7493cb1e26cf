"""Operators of a training-data pipeline: dedup, packing, search, language, quality, toxicity, sharding."""
