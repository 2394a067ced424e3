"""operators of the interaction engine."""
