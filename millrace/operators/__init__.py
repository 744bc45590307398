"""The operators of the engine."""
