"""Operators of a training-data pipeline: dedup, filters, search, mixing, WARC."""
