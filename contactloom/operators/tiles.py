"""Counts of pairs between the tiles around loops and regions.

A pair near a loop is joined with it once; which tiles its ends touch follows by
arithmetic, and the two lists are crossed (they hold a few entries). Tiles are
closed at both ends, so a position on a border is in two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators import intervals

Place = Callable[[Column], tuple[Column, Column]]


def _whole(start: Column, end: Column) -> tuple[Column, Column]:
    """The positions within real bounds that are cut at zero."""
    zero = F.lit(0).cast("long")
    return F.ceil(F.greatest(start.cast("double"), F.lit(0.0))).cast("long"), F.greatest(F.floor(end.cast("double")).cast("long"), zero)


def shifted(side: str) -> Place:
    """Copies of an anchor, moved by multiples of the mean half width of both anchors."""
    c = (F.col(f"start_{side}") + F.col(f"end_{side}")) / 2
    half = (F.col(f"end_{side}") - F.col(f"start_{side}")) / 2
    step = (F.col("end_a") - F.col("start_a") + F.col("end_b") - F.col("start_b")) / 4
    return lambda i: _whole(c + i * step - half, c + i * step + half)


def adjacent(side: str) -> Place:
    """Tiles of an anchor's own width, on from its start."""
    start, width = F.col(f"start_{side}"), F.col(f"end_{side}") - F.col(f"start_{side}")
    return lambda i: _whole(start + i * width, start + (i + 1) * width)


def _numbers(reach: int, centre: bool) -> Column:
    return F.array(*[F.lit(i) for i in range(-reach, reach + 1) if i or centre])


def counts(points: DataFrame, loops: DataFrame, place: Callable[[str], Place], reach: int, centre: bool) -> DataFrame:
    """loop_id, i, j and n: pairs with any end in tile i of anchor a and any end in tile j of anchor b, where there are any."""
    rects = loops.select("loop_id", "chrom", "start_a", "end_a", "start_b", "end_b")
    outer = {}
    for s in "ab":
        at = place(s)
        outer[f"o_start_{s}"], outer[f"o_end_{s}"] = at(F.lit(-reach))[0], at(F.lit(reach))[1]
    whole = rects.withColumns(outer).select("loop_id", "chrom", *[F.col(f"o_{k}_{s}").alias(f"{k}_{s}") for s in "ab" for k in ("start", "end")], F.struct("start_a", "end_a", "start_b", "end_b").alias("own"))
    near = intervals.rectangle_hits(points, whole).select("loop_id", "x", "y", "own.*")

    def touched(side: str) -> Column:
        def test(i: Column) -> Column:
            start, end = place(side)(i)
            return F.col("x").between(start, end) | F.col("y").between(start, end)

        return F.filter(_numbers(reach, centre), test)

    both = near.select("loop_id", touched("a").alias("i"), touched("b").alias("j")).where((F.size("i") > 0) & (F.size("j") > 0))
    return both.select("loop_id", F.explode("i").alias("i"), "j").select("loop_id", "i", F.explode("j").alias("j")).groupBy("loop_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def anchor_windows(loops: DataFrame, place: Callable[[str], Place], reach: int) -> DataFrame:
    """loop_id, side, i, chrom, start and end of the moved anchors."""
    sides = []
    for s in "ab":
        at = place(s)
        spans = [F.struct(F.lit(s).alias("side"), F.lit(i).alias("i"), at(F.lit(i))[0].alias("start"), at(F.lit(i))[1].alias("end")) for i in range(-reach, reach + 1) if i]
        sides += spans
    return loops.select("loop_id", "chrom", F.explode(F.array(*sides)).alias("w")).select("loop_id", "chrom", "w.*")


def background(points: DataFrame, loops: DataFrame, reach: int = 5) -> DataFrame:
    """loop_id with tiles and densities of the moved anchors: ascending lists of what is above zero, of (2 * reach) ** 2 each.

    A density is the pairs of two tiles over the product of the pairs that touch each.
    """
    cells = counts(points, loops, shifted, reach, False)
    windows = anchor_windows(loops, shifted, reach).select("chrom", "start", "end", F.struct("loop_id", "side", "i").alias("wid"))
    touching = intervals.window_counts(points, windows, "wid").select("wid.*", "any_end")
    side = {s: touching.where(F.col("side") == s).select("loop_id", F.col("i").alias(k), F.col("any_end").alias(f"n{s}")) for s, k in (("a", "i"), ("b", "j"))}
    dense = cells.join(side["a"], ["loop_id", "i"]).join(side["b"], ["loop_id", "j"])
    return dense.groupBy("loop_id").agg(
        F.array_sort(F.collect_list("n")).alias("tiles"), F.array_sort(F.collect_list(F.col("n") / (F.col("na") * F.col("nb")))).alias("densities")
    )


def padded_median(values: Column, total: int) -> Column:
    """Median of ascending values above zero and zeros, ``total`` in all; an even number."""
    def at(i: int) -> Column:
        return F.coalesce(F.get(values, F.when(F.size(values) >= total - i, F.size(values) - total + i)).cast("double"), F.lit(0.0))

    return (at(total // 2 - 1) + at(total // 2)) / 2


def padded_mean(values: Column, total: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / total


def grid_counts(points: DataFrame, spans: DataFrame, tiles: int) -> DataFrame:
    """region_id, i, j and n of spans (region_id, chrom, start, end) cut into ``tiles`` equal tiles from the start: pairs that touch both tiles.

    The width is rounded down, so what is over at the end is left out.
    """
    w = spans.withColumn("width", F.floor((F.col("end") - F.col("start")) / tiles).cast("long")).where("width > 0 AND start >= 0")
    w = w.select("region_id", "chrom", F.col("start").cast("double").alias("s"), "width")
    # closed tiles [s + width * i, s + width * (i + 1)] with a real s
    windows = w.select("*", F.ceil("s").cast("long").alias("start"), F.floor(F.col("s") + F.col("width") * tiles).cast("long").alias("end"))
    found = intervals.hits(intervals.ends(points), "pos", windows)

    def touched(at: str) -> Column:
        off = F.col(at) - F.col("s")
        i = F.floor(off / F.col("width")).cast("int")
        own = F.when(i * F.col("width") == off, F.array(i, i - 1)).otherwise(F.array(i))
        return F.when(F.col(at).between(F.col("start"), F.col("end")), F.filter(own, lambda v: (v >= 0) & (v < tiles))).otherwise(F.array().cast("array<int>"))

    # a pair with both ends inside was found twice
    inside = F.col("x").between(F.col("start"), F.col("end"))
    sides = found.where((F.col("side") == "x") | ~inside)
    both = sides.select("region_id", F.array_union(touched("x"), touched("y")).alias("u"))
    return both.select("region_id", F.explode("u").alias("i"), "u").select("region_id", "i", F.explode("u").alias("j")).groupBy("region_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))
