"""Structured Streaming forms of the incremental path."""
