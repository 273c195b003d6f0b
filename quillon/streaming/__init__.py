"""Structured Streaming over statement logs."""
