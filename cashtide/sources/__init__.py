"""Readers, writers and run provenance."""
