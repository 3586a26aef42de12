"""Structured Streaming forms of the log means and of exact deduplication."""
