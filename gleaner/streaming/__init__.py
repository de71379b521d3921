"""Structured Streaming versions of the incremental runs."""
