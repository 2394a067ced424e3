"""sources of the interaction engine."""
