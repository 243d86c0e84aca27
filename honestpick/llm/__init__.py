"""Operators of a training-data pipeline: quality, duplicates, secrets, markup, tokens."""
