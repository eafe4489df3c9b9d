"""Structured Streaming form of incremental ingest."""
