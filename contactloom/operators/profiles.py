"""Signals along regions and matrices around them, for single regions and as means over many.

Signals are kept sparse, as (region_id, bin, value) or (region_id, i, j, n); what is
not listed is zero. Means divide by the number of regions, listed or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators import intervals, tiles


def _spread(spans: DataFrame, bins: int) -> DataFrame:
    """region_id, bin, value: mean of the values of half-open spans (region_id, start, end, s, e, v) in ``bins`` equal bins of [start, end).

    A bin's width is rounded down; what is over at the end is left out.
    """
    width = F.floor((F.col("end") - F.col("start")) / bins)
    at = spans.withColumns({"w": width, "p": F.greatest(F.col("s"), F.col("start")) - F.col("start"), "q": F.least(F.col("e"), F.col("end")) - F.col("start")})
    at = at.where("w > 0 AND p < q")
    at = at.withColumn("bin", F.explode(F.sequence(F.floor(F.col("p") / F.col("w")), F.floor((F.col("q") - 1) / F.col("w"))))).where(F.col("bin") < bins)
    part = F.least(F.col("q"), (F.col("bin") + 1) * F.col("w")) - F.greatest(F.col("p"), F.col("bin") * F.col("w"))
    return at.groupBy("region_id", F.col("bin").cast("int").alias("bin")).agg((F.sum(part * F.col("v")) / F.first("w")).alias("value"))


def tag_profiles(points: DataFrame, regions: DataFrame, bins: int = 100, ext: int = 20) -> DataFrame:
    """Mean cover by ends inside the regions (region_id, chrom, start, end), each ``ext`` to both sides, in bins."""
    found = intervals.hits(intervals.ends(points), "pos", regions.select("region_id", "chrom", "start", "end"))
    spans = found.select("region_id", "start", "end", (F.col("pos") - ext).alias("s"), (F.col("pos") + ext).alias("e"), F.lit(1.0).alias("v"))
    return _spread(spans.where(F.col("end") - F.col("start") >= bins), bins)


def pair_profiles(points: DataFrame, regions: DataFrame, bins: int = 100, ext: int = 50) -> DataFrame:
    """Mean cover by whole pairs with both ends inside."""
    found = intervals.hits(points, "x", regions.select("region_id", "chrom", "start", "end")).where("y <= end")
    return _spread(found.select("region_id", "start", "end", (F.col("x") - ext).alias("s"), (F.col("y") + ext).alias("e"), F.lit(1.0).alias("v")), bins)


def signal_profiles(signal: DataFrame, regions: DataFrame, bins: int = 100, reverse: Column | None = None) -> DataFrame:
    """Mean of a signal (chrom, start, end half-open, value) over each region in bins, as read from bedGraph or bigWig.

    Spans meet regions where one holds the start of the other. ``reverse`` (of
    columns of ``regions``) turns regions round.
    """
    turn = F.lit(False) if reverse is None else reverse
    r = regions.withColumn("turn", turn).select("region_id", "chrom", F.ceil("start").cast("long").alias("start"), F.ceil("end").cast("long").alias("end"), "turn").where(F.col("end") - F.col("start") >= bins)
    inside = intervals.hits(signal.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "value"), "s", r.withColumn("end", F.col("end") - 1)).withColumn("end", F.col("end") + 1)
    spans = signal.select("chrom", "start", (F.col("end") - 1).alias("end"), "value")
    over = intervals.hits(r.select("chrom", F.col("start").alias("rs"), F.col("end").alias("re"), "region_id", "turn"), "rs", spans).where("start < rs")
    both = inside.select("region_id", "start", "end", "s", "e", F.col("value").alias("v"), "turn").unionByName(
        over.select("region_id", F.col("rs").alias("start"), F.col("re").alias("end"), F.col("start").alias("s"), (F.col("end") + 1).alias("e"), F.col("value").alias("v"), "turn")
    )
    out = _spread(both, bins).join(r.select("region_id", "turn"), "region_id")
    return out.select("region_id", F.when(F.col("turn"), bins - 1 - F.col("bin")).otherwise(F.col("bin")).alias("bin"), "value")


def mean_profile(profiles: DataFrame, regions: int, bins: int) -> DataFrame:
    """bin and the mean value over ``regions`` regions, zeros with them."""
    every = profiles.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    sums = profiles.groupBy("bin").agg(F.sum("value").alias("value"))
    return every.join(sums, "bin", "left").select("bin", (F.coalesce("value", F.lit(0.0)) / max(regions, 1)).alias("value"))


def peak_windows(peaks: DataFrame, ext: int = 5_000) -> DataFrame:
    """``ext`` to both sides of the middle of each region, cut at zero."""
    mid = (F.col("start") + F.col("end")) / 2
    return peaks.select("region_id", "chrom", F.floor(F.greatest(F.lit(0.0), mid - ext)).cast("long").alias("start"), F.floor(mid + ext).cast("long").alias("end"))


def peak_profiles(pets: DataFrame, peaks: DataFrame, total: int, ext: int = 5_000, bins: int = 100) -> DataFrame:
    """Tags around the middles of peaks, per million tags."""
    return tag_profiles(intervals.points(pets), peak_windows(peaks, ext), bins).withColumn("value", F.col("value") / (2 * total) * 1e6)


def loop_tiles(pets: DataFrame, loops: DataFrame, ext: int = 10) -> DataFrame:
    """loop_id, i, j, n: pairs between the (ext + 1) ** 2 tiles around each loop, centre at 0, 0."""
    return tiles.counts(intervals.points(pets), loops, tiles.adjacent, ext // 2, True)


def anchor_windows(loops: DataFrame, ext: int = 10) -> DataFrame:
    """Both anchors with ``ext`` of their widths to both sides, as regions."""
    sides = [F.struct(F.concat_ws(":", F.col("loop_id").cast("string"), F.lit(s)).alias("region_id"), *[
        (F.col(f"{k}_{s}") + sign * ext * (F.col(f"end_{s}") - F.col(f"start_{s}"))).alias(k) for k, sign in (("start", -1), ("end", 1))
    ]) for s in "ab"]
    return loops.select("chrom", F.explode(F.array(*sides)).alias("w")).select("w.region_id", "chrom", "w.start", "w.end")


def span_windows(loops: DataFrame, ext: float = 0.25) -> DataFrame:
    """The span of both anchors with ``ext`` of its length to both sides; spans that would begin below zero go."""
    low, high = F.least("start_a", "start_b"), F.greatest("end_a", "end_b")
    return loops.select(F.col("loop_id").alias("region_id"), "chrom", (low - ext * (high - low)).alias("start"), (high + ext * (high - low)).alias("end")).where("start >= 0")


def domain_windows(domains: DataFrame, ext: float = 0.5) -> DataFrame:
    size = F.col("end") - F.col("start")
    return domains.select("region_id", "chrom", (F.col("start") - ext * size).alias("start"), (F.col("end") + ext * size).alias("end")).where("start >= 0")


def span_tiles(pets: DataFrame, windows: DataFrame, parts: int = 100) -> DataFrame:
    """region_id, i, j, n: pairs between ``parts`` tiles of each window."""
    return tiles.grid_counts(intervals.points(pets), windows, parts)


def viewpoint_cells(pets: DataFrame, regions: DataFrame, up: int = 100_000, down: int = 100_000, size: int = 1_000) -> DataFrame:
    """region_id, i, j, n: symmetric cells of the pairs from ``up`` before to ``down`` after the middle of each region.

    The diagonal counts twice, the last, broken bin is left out, and regions too near to zero go.
    """
    mid = (F.col("start") + F.col("end")) / 2
    w = regions.select("region_id", "chrom", (mid - up).alias("s"), (mid + down).alias("e")).where("s > 0")
    windows = w.select("region_id", "chrom", "s", F.ceil("s").cast("long").alias("start"), F.floor("e").cast("long").alias("end"))
    found = intervals.hits(intervals.points(pets), "x", windows).where("y <= end")
    last = (up + down) // size
    cells = found.select("region_id", *[F.floor((F.col(c) - F.col("s")) / size).cast("int").alias(k) for c, k in (("x", "i"), ("y", "j"))])
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    out = cells.select("region_id", F.explode(both).alias("c")).select("region_id", "c.i", "c.j").where((F.col("i") < last) & (F.col("j") < last))
    return out.groupBy("region_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def mean_cells(cells: DataFrame, regions: int, norm: bool = False, id: str = "region_id") -> DataFrame:
    """i, j and the mean over regions; with ``norm`` of each region's share of its own sum."""
    value = F.col("n").cast("double")
    if norm:
        cells = cells.join(cells.groupBy(id).agg(F.sum("n").alias("_s")), id)
        value = F.col("n") / F.col("_s")
    return cells.groupBy("i", "j").agg((F.sum(value) / max(regions, 1)).alias("value"))


def virtual_4c(pets: DataFrame, key: str, start: int, end: int, view_start: int, view_end: int, ext: int = 20) -> DataFrame:
    """Depth of the pairs of a window that touch the view point without lying in it: chrom, start, end, depth, log2 of the depth."""
    rows = pets.where((F.col("key") == key) & (F.col("x") >= start) & (F.col("y") <= end)).select(F.col("chrom_a").alias("chrom"), "x", "y")
    a, b = (F.col(c).between(view_start, view_end) for c in "xy")
    seen = intervals.ends(rows.where((a | b) & ~(a & b)))
    spans = seen.select("chrom", F.greatest(F.lit(start), F.col("pos") - ext).alias("start"), F.least(F.lit(end), F.col("pos") + ext).alias("end"))
    return intervals.spans_depth(spans.where("start < end")).withColumn("log2_depth", F.log2("depth"))


def region_links(pets: DataFrame, regions: DataFrame, total: int | None = None) -> DataFrame:
    """Pairs between every two regions of a chromosome that share any: id_a < id_b, n, and per million of ``total``.

    A pair meets the regions that its ends lie in; these few are crossed.
    """
    points = intervals.points(pets).withColumn("pid", F.struct("chrom", "x", "y"))
    found = intervals.hits(intervals.ends(points), "pos", regions.select("region_id", "chrom", "start", "end")).select("pid", "side", "region_id")
    both = found.groupBy("pid").agg(F.array_sort(F.collect_set("region_id")).alias("r")).where(F.size("r") > 1)
    # a pair of equal places that occurs more than once counts as often
    often = points.groupBy("pid").agg(F.count(F.lit(1)).alias("c"))
    each = both.join(often, "pid").select(F.explode("r").alias("id_a"), "r", "c").select("id_a", F.explode("r").alias("id_b"), "c").where("id_a < id_b")
    out = each.groupBy("id_a", "id_b").agg(F.sum("c").alias("n"))
    return out if total is None else out.withColumn("per_million", F.col("n") / total * 1e6)
