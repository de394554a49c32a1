"""Pipelines over Structured Streaming sources."""
