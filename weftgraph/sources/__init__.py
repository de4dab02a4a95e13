"""Readers, writers and extractors that make graph tables."""
