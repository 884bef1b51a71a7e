"""Incremental forms of the scans and of deduplication."""
