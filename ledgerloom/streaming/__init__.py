"""Structured Streaming jobs over a landing directory (M1-M7)."""
