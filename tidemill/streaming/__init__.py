"""Append-only ingest of JSON streams, producers and monitoring."""
