"""Relational, graph and lint operators over the five graph tables."""
