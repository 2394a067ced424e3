"""Range joins, counts in windows and rectangles, stitching, coverage, nearest starts.

**Range joins.** A window goes to the one or two bins it touches at the level of
its own length (widths are powers of four), a position to its bin at each level in
use, so a range predicate becomes an equality on (chromosome, level, bin) with an
exact test after it: no cross join, and the longest window costs two rows. Hot
bins are left to the skew handling of adaptive execution.

**Sweeps.** Running sums and maxima along a chromosome are taken within tiles of
``TILE`` bases, and what a tile inherits comes from a summary with one row for
each tile. No task sees a whole chromosome.

Points are (chrom, x, y) with any label as ``chrom``; ends of windows are
inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Logarithm to base four of the narrowest bins; bases of a tile.
LEAST_LEVEL, TILE = 5, 1 << 16


def points(pets: DataFrame) -> DataFrame:
    """Cis pairs as (chrom, x, y)."""
    return pets.where("dist IS NOT NULL").select(F.col("chrom_a").alias("chrom"), "x", "y")


def _level(length: Column) -> Column:
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(length.cast("double") + 2) / 2)).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(4.0), level)).cast("long")


def _levels(windows: DataFrame) -> list[int]:
    """The levels in use: at most some twenty numbers, whatever the table."""
    return sorted(r[0] for r in windows.select(_level(F.col("end") - F.col("start"))).distinct().collect() if r[0] is not None)


def _placed(windows: DataFrame) -> DataFrame:
    """The windows with _l and _b, once for each bin."""
    w = windows.where("start <= end").withColumn("_l", _level(F.col("end") - F.col("start")))
    return w.withColumn("_b", F.explode(F.sequence(_bin(F.col("start"), F.col("_l")), _bin(F.col("end"), F.col("_l")))))


def hits(points: DataFrame, at: str, windows: DataFrame) -> DataFrame:
    """Points (chrom, ``at``, ...) joined with the windows (chrom, start, end, ...) that they lie in."""
    levels = _levels(windows)
    p = points.withColumn("_l", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    p = p.withColumn("_b", _bin(F.col(at), F.col("_l")))
    return p.join(_placed(windows), ["chrom", "_l", "_b"]).where(F.col(at).between(F.col("start"), F.col("end"))).drop("_l", "_b")


def ends(points: DataFrame) -> DataFrame:
    """Both ends in rows: all columns, side, pos."""
    side = F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("pos")), F.struct(F.lit("y").alias("side"), F.col("y").alias("pos"))))
    return points.select("*", side.alias("_e")).select(*points.columns, "_e.side", "_e.pos")


def _inside(at: str, start: str = "start", end: str = "end") -> Column:
    return F.col(at).between(F.col(start), F.col(end))


def window_counts(points: DataFrame, windows: DataFrame, id: str) -> DataFrame:
    """id, any_end and both_ends: pairs with any end, and with both, in each window that has any."""
    found = hits(ends(points), "pos", windows)
    # a pair inside with both ends shows up twice, as x and as y
    inside = _inside("x") & _inside("y")
    return found.groupBy(id).agg(
        F.count_if((F.col("side") == "x") | ~inside).alias("any_end"), F.count_if((F.col("side") == "x") & inside).alias("both_ends")
    )


def both_counts(points: DataFrame, windows: DataFrame, id: str) -> DataFrame:
    """id and n: pairs with both ends in each window that has any."""
    return hits(points, "x", windows).where(_inside("y")).groupBy(id).agg(F.count(F.lit(1)).alias("n"))


def rectangle_hits(points: DataFrame, rects: DataFrame) -> DataFrame:
    """Pairs with any end in [start_a, end_a] and any end in [start_b, end_b], once for each rectangle: x, y and its columns.

    One end counts for both anchors where they overlap.
    """
    a = rects.withColumns({"start": F.col("start_a"), "end": F.col("end_a")})
    found = hits(ends(points), "pos", a)
    far = _inside("x", "start_b", "end_b") | _inside("y", "start_b", "end_b")
    return found.where(far & ((F.col("side") == "x") | ~_inside("x"))).drop("start", "end", "side", "pos")


def rectangle_counts(points: DataFrame, rects: DataFrame, id: str, name: str = "n") -> DataFrame:
    """id and the number of pairs of each rectangle that has any."""
    return rectangle_hits(points, rects).groupBy(id).agg(F.count(F.lit(1)).alias(name))


def region_counts(pets: DataFrame, regions: DataFrame) -> DataFrame:
    """The regions with any_end, both_ends and distal (0 where none)."""
    counts = window_counts(points(pets), regions.select("region_id", "chrom", "start", "end"), "region_id")
    out = regions.join(counts, "region_id", "left").fillna(0, ["any_end", "both_ends"])
    return out.withColumn("distal", F.col("any_end") - F.col("both_ends"))


def loop_counts(pets: DataFrame, loops: DataFrame) -> DataFrame:
    """The loops with the pairs that join their anchors."""
    counts = rectangle_counts(points(pets), loops.select("loop_id", "chrom", "start_a", "end_a", "start_b", "end_b"), "loop_id", "pets")
    return loops.join(counts, "loop_id", "left").fillna(0, ["pets"])


def _tile(at: str = "start") -> Column:
    return F.floor(F.col(at) / TILE).alias("tile")


def _earlier(*by: str) -> Window:
    return Window.partitionBy("chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)


def _later() -> Window:
    return Window.partitionBy("chrom").orderBy("tile").rowsBetween(1, Window.unboundedFollowing)


def _within(*order) -> Window:
    return Window.partitionBy("chrom", "tile").orderBy(*order)


_UPTO = (Window.unboundedPreceding, 0)


def stitch(regions: DataFrame, gap: int = 1) -> DataFrame:
    """Runs of regions not further apart than ``gap``: chrom, start, end, n.

    A run is named by the start that opens it; both the furthest end so far and the
    run so far are running maxima.
    """
    rows = regions.select("chrom", "start", "end", _tile())
    carry = rows.groupBy("chrom", "tile").agg(F.max("end").alias("end")).select("chrom", "tile", F.max("end").over(_earlier()).alias("carry"))
    order = _within("start", "end")
    reach = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry"))
    opened = rows.join(carry, ["chrom", "tile"]).withColumn("reach", reach)
    opened = opened.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + gap), F.col("start"))).drop("carry", "reach")
    runs = opened.groupBy("chrom", "tile").agg(F.max("opens").alias("last")).select("chrom", "tile", F.max("last").over(_earlier()).alias("carry"))
    # by range, so that rows of one start see the one of them that opens a run
    run = F.coalesce(F.max("opens").over(_within("start").rangeBetween(*_UPTO)), F.col("carry"))
    named = opened.join(runs, ["chrom", "tile"]).select("chrom", "end", run.alias("run"))
    return named.groupBy("chrom", F.col("run").alias("start")).agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def placed_in(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """``spans`` (chrom, start, end, ...) with run_start and run_end of the run that holds their start."""
    r = runs.select("chrom", "start", "end")
    held = hits(spans.withColumnsRenamed({"start": "_s", "end": "_e"}), "_s", r)
    return held.withColumnsRenamed({"start": "run_start", "end": "run_end"}).withColumnsRenamed({"_s": "start", "_e": "end"})


def touching(pets: DataFrame, regions: DataFrame, inverse: bool = False, gap: int = 1) -> DataFrame:
    """Cis pairs with any end in any region; inverse: with none."""
    cis = pets.where("dist IS NOT NULL")
    found = hits(ends(points(pets)), "pos", stitch(regions, gap)).select(F.col("chrom").alias("chrom_a"), "x", "y").distinct()
    return cis.join(found, ["chrom_a", "x", "y"], "left_anti" if inverse else "left_semi")


def joining(pets: DataFrame, loops: DataFrame, inverse: bool = False) -> DataFrame:
    """Cis pairs (chrom, x, y) that join the anchors of any loop; inverse: of none."""
    p = points(pets)
    found = rectangle_hits(p, loops.select("chrom", "start_a", "end_a", "start_b", "end_b")).select("chrom", "x", "y").distinct()
    return p.join(found, ["chrom", "x", "y"], "left_anti") if inverse else found


def anchors(loops: DataFrame) -> DataFrame:
    """Both anchors of every loop in rows: loop_id, chrom, side, start, end."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"start_{s}").alias("start"), F.col(f"end_{s}").alias("end")) for s in "ab"])
    return loops.select("loop_id", "chrom", F.explode(sides).alias("e")).select("loop_id", "chrom", "e.side", "e.start", "e.end")


def overlaps(a: DataFrame, b: DataFrame, same: bool = True) -> DataFrame:
    """Pairs of regions that share a position: chrom, id_a, id_b; with ``same``, id_a < id_b of one table.

    Of two intervals that overlap, one holds the other's start, so this is a point
    join of the starts with the intervals, from both sides.
    """
    def starts(d: DataFrame, id: str) -> DataFrame:
        return d.select("chrom", F.col("region_id").alias(id), F.col("start").alias("pos"))

    first = hits(starts(b, "id_b"), "pos", a.select("chrom", F.col("region_id").alias("id_a"), "start", "end"))
    second = hits(starts(a, "id_a"), "pos", b.select("chrom", F.col("region_id").alias("id_b"), "start", "end")).where("pos > start")
    met = first.select("chrom", "id_a", "id_b").unionByName(second.select("chrom", "id_a", "id_b"))
    if not same:
        return met
    return met.where("id_a <> id_b").select("chrom", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def running(steps: DataFrame, *names: str) -> DataFrame:
    """``steps`` (chrom, start, one row a place, ...) with the running sums of the named columns and the next place as ``end``."""
    rows = steps.withColumn("tile", _tile())
    sums = rows.groupBy("chrom", "tile").agg(*[F.sum(n).alias(n) for n in names], F.min("start").alias("first"))
    carry = sums.select("chrom", "tile", *[F.coalesce(F.sum(n).over(_earlier()), F.lit(0)).alias(f"_{n}") for n in names], F.first("first").over(_later()).alias("_next"))
    order = _within("start")
    out = rows.join(carry, ["chrom", "tile"])
    out = out.withColumns({n: F.sum(n).over(order.rowsBetween(*_UPTO)) + F.col(f"_{n}") for n in names} | {"end": F.coalesce(F.lead("start").over(order), F.col("_next"))})
    return out.drop("tile", "_next", *[f"_{n}" for n in names])


def spans_depth(spans: DataFrame) -> DataFrame:
    """Runs of equal depth above zero of half-open spans (chrom, start, end): chrom, start, end, depth."""
    edge = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step"))))
    steps = spans.select("chrom", edge.alias("e")).groupBy("chrom", F.col("e.at").alias("start")).agg(F.sum("e.step").alias("depth"))
    return running(steps.where("depth <> 0"), "depth").where("depth > 0").select("chrom", "start", "end", "depth")


def coverage(pets: DataFrame, ext: int = 50, pairs: bool = False) -> DataFrame:
    """Depth of both ends, each extended to both sides and cut at zero, or of whole pairs from x - ext to y + ext."""
    p = points(pets)
    if pairs:
        spans = p.select("chrom", F.greatest(F.lit(0), F.col("x") - ext).alias("start"), (F.col("y") + ext).alias("end"))
    else:
        spans = ends(p).select("chrom", F.greatest(F.lit(0), F.col("pos") - ext).alias("start"), (F.col("pos") + ext).alias("end"))
    return spans_depth(spans)


def nearest(spots: DataFrame, targets: DataFrame) -> DataFrame:
    """``spots`` (chrom, pos, ...) with ``found``: the target (chrom, pos, target) nearest to each, as (distance, target).

    Ties go to the smaller target; null where the chromosome has none. Both sides
    are merged into one ordered sequence; the last target before and the first one
    after each spot come from the tile or are handed on from its neighbours.
    """
    g = targets.groupBy("chrom", "pos").agg(F.min("target").alias("target")).select("chrom", "pos", F.struct("pos", "target").alias("at"))
    kind, whole = g.schema["at"].dataType, F.struct(*spots.columns)
    both = g.select("chrom", "pos", "at", F.lit(None).cast(spots.select(whole.alias("w")).schema["w"].dataType).alias("spot"))
    both = both.unionByName(spots.select("chrom", "pos", F.lit(None).cast(kind).alias("at"), whole.alias("spot"))).withColumn("tile", _tile("pos"))
    known = both.groupBy("chrom", "tile").agg(F.max("at").alias("last"), F.min("at").alias("first"))
    carry = known.select("chrom", "tile", F.last("last", True).over(_earlier()).alias("_b"), F.first("first", True).over(_later()).alias("_a"))
    order = _within("pos", F.col("spot").isNotNull())
    before = F.coalesce(F.last("at", True).over(order.rowsBetween(*_UPTO)), F.col("_b"))
    after = F.coalesce(F.first("at", True).over(order.rowsBetween(0, Window.unboundedFollowing)), F.col("_a"))
    seen = both.join(carry, ["chrom", "tile"]).select("pos", "spot", before.alias("b"), after.alias("a")).where("spot IS NOT NULL")
    far = [F.struct(F.abs(F.col(f"{s}.pos") - F.col("pos")).alias("distance"), F.col(f"{s}.target").alias("target")) for s in "ba"]
    best = F.array_min(F.filter(F.array(*far), lambda s: s["distance"].isNotNull()))
    return seen.select("spot.*", best.alias("found"))


def nearest_start(regions: DataFrame, genes: DataFrame, pdis: int = 2_000) -> DataFrame:
    """The gene start nearest to each region's middle (ties: the smaller id), its distance and the kind of region."""
    spots = regions.select("chrom", F.expr("(start + end) div 2").alias("pos"), "region_id")
    found = nearest(spots, genes.select("chrom", F.col("tss").alias("pos"), F.col("gene_id").alias("target")))
    out = found.select("region_id", F.col("found.target").alias("gene_id"), "found.distance")
    return out.withColumn("kind", F.when(F.col("distance") <= pdis, "Promoter").otherwise("Enhancer"))
