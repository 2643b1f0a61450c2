"""Structured Streaming jobs over arriving listings."""
