"""Incremental counterparts of batch operators on Structured Streaming."""
