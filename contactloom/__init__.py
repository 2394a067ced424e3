"""Chromatin-interaction analytics as Spark DataFrame queries."""
