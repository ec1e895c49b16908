"""Structured Streaming variants of the stateless steps."""
