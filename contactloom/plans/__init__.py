"""plans of the interaction engine."""
