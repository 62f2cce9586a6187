"""Operators for training data: deduplication, filtering, formatting, mixing and sharding."""
