"""Operators of a training-data pipeline: deduplication, mixing, scans, scoring, sharding."""
