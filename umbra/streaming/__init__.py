"""Structured Streaming ingest of arriving raw files."""
