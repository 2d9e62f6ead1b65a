"""Operators of a training-data pipeline: filtering, deduplication, scans and encoding of text."""
