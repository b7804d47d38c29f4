"""Whole queries composed from operators, and the registry of named queries."""
