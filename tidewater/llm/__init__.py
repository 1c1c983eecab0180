"""Operators of a training-data pipeline: sharding, token files, tokenising, quality, mixing, safety, deduplication."""
