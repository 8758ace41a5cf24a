"""Operators of a training-data pipeline: search, dedup, filtering, mixing and sharding."""
