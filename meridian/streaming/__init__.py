"""Structured Streaming over scene metadata."""
