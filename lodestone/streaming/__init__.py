"""Structured Streaming jobs; each equals a batch operator over the same rows."""
