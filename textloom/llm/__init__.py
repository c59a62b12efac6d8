"""Operators of a training-data pipeline: packing, scoring, formatting, filtering, deduplication."""
