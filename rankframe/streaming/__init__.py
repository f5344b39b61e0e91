"""Append-only outputs, resume and running totals as Structured Streaming."""
