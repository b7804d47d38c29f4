"""Scans, sinks, persisted indexes and the contracts of what is read and written."""
