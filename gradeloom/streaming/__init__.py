"""Incremental scoring as a stream."""
