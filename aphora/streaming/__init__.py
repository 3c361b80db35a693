"""Structured Streaming jobs; each shares its transformation with a batch operator where one exists."""
