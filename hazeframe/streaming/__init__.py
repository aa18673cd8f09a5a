"""Structured Streaming ingestion of landed files."""
