"""Incremental counters."""
