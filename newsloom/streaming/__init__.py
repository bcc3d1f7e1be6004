"""Structured Streaming forms of indexing and of the result cache."""
