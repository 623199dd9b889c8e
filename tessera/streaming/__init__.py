"""Structured Streaming forms of rollups and subscriptions."""
