"""Structured Streaming forms of ingest, metrics and quality."""
