"""Structured Streaming counterparts of the polling features."""
