"""Structured Streaming versions of the event operators."""
