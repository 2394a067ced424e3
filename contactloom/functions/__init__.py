"""functions of the interaction engine."""
