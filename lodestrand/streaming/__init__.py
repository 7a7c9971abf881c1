"""Structured Streaming forms of the mirror operators."""
