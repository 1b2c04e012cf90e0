"""Structured Streaming forms of the prediction plan."""
