"""Structured Streaming forms of the panel and of the forward repair."""
