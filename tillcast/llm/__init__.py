"""Operators for preparing training text: scans, filters, deduplication, scoring and tokenization."""
