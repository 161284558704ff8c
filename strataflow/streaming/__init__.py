"""Structured Streaming over arriving readings."""
