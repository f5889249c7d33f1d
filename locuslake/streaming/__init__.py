"""Incremental versions of operators on Structured Streaming."""
