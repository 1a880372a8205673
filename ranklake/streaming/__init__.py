"""Structured Streaming forms of the behaviour statistics."""
