"""Operators beyond the query planner: search, history, rollups, views."""
