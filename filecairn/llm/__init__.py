"""Operators of a training-data pipeline: packing, scoring, mixing, search, sanitising, near copies."""
