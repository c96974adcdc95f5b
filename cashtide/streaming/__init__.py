"""Structured Streaming versions of ingest, windowed revenue and the quality gate."""
