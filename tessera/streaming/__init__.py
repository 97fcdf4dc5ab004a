"""Structured Streaming: message parsing, evolving loads with dead letters, change data capture, windows."""
