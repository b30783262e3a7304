"""Structured Streaming forms of the event and ingest operators."""
