"""Pairs from a stream of files: canonical, filtered, and once each within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from contactloom.operators import pets


def unique_pairs(raw: DataFrame, time: str, delay: str = "1 hour", **limits) -> DataFrame:
    """``raw`` is a streaming frame with an event time; state older than the delay is let go."""
    kept = pets.keep(pets.canonical(raw), **limits)
    return kept.withWatermark(time, delay).dropDuplicatesWithinWatermark(["key", "x", "y"])
