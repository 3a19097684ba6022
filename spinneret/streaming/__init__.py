"""Structured Streaming jobs over page results."""
