"""Incremental (Structured Streaming) form of the effect estimate."""
