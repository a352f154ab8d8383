"""Structured Streaming jobs; each gives what its batch twin gives on the same input."""
