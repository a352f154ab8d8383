"""Column expressions: null-aware arithmetic, text, counters and probability."""
