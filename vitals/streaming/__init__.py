"""Structured Streaming ingest, de-duplication and daily roll-up."""
