"""Incremental loads expressed as Structured Streaming jobs."""
