"""Consume-once feeds with Structured Streaming."""
