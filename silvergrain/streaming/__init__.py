"""Incremental versions of ingest, burst detection and scoring."""
