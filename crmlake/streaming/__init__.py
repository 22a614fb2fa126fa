"""Structured Streaming jobs (activity log append)."""
