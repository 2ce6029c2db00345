"""Readers, adapters and ingest."""
