"""Operators of a training-data pipeline: mixing, extraction, deduplication, filtering and output."""
