"""Functions of the addressing engine."""
