"""Streams of diffs: the per-diff operators on Structured Streaming."""
