"""Structured Streaming into the index tables."""
