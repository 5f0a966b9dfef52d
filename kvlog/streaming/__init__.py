"""Change feeds and incremental state as Structured Streaming queries."""
