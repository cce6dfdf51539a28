"""Structured Streaming forms of some marts."""
