"""Incremental forms of the batch operators, with Structured Streaming."""
