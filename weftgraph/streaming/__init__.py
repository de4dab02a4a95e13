"""Structured Streaming: incremental refresh of the graph tables."""
