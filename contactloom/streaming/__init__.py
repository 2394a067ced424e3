"""streaming of the interaction engine."""
