"""Structured Streaming forms of the refresh cycle."""
