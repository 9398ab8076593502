"""Structured Streaming forms of the lookups and of ingestion."""
