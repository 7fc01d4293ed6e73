"""Sources of the addressing engine."""
