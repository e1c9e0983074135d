"""Column expressions: text, time, rounding, buckets."""
