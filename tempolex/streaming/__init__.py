"""Structured Streaming over recorded calls and documents."""
