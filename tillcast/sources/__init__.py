"""Scans and sinks: JSONL landing, CSV reference files, Parquet tables, sample-data adapter."""
