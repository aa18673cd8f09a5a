"""Scans and sinks: landed CSV / JSON, the processed table, stand-in views over driver tables."""
