"""Structured Streaming jobs over ad-click lines."""
