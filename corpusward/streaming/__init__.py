"""Structured Streaming: the line scan on arriving files and rolling views of findings."""
