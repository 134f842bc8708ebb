"""Structured Streaming: captured pages arrive as files, facts are appended in micro-batches."""
