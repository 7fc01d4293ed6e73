"""Operators of the addressing engine."""
