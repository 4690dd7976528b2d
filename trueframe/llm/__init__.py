"""Operators of a training-data pipeline: deduplication, scoring, mixing, packing, formats."""
