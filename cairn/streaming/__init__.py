"""Incremental ingest and counters on Structured Streaming."""
