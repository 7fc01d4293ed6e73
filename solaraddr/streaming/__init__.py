"""Streaming of the addressing engine."""
