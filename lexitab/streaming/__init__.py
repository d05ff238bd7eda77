"""Incremental stores and Structured Streaming jobs."""
