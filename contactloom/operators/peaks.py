"""Peaks: candidates from clusters whose ends meet, tests against their surroundings and a control, choice, correction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import tails
from contactloom.operators import cluster, estimates, intervals, selection


def tags(points: DataFrame, ext: int = 50) -> DataFrame:
    """Every end as a pair of its own, ``ext`` to both sides."""
    return intervals.ends(points).select("chrom", (F.col("pos") - ext).alias("x"), (F.col("pos") + ext).alias("y"))


def candidates(points: DataFrame, eps: tuple[int, ...], min_pts: tuple[int, ...]) -> DataFrame:
    """Peaks (peak_id, chrom, start, end, length) of every combination: boxes whose sides meet within eps, stitched within eps; once each."""
    rows, found = points.select(F.col("chrom").alias("key"), "x", "y"), []
    for e in eps:
        for m in min_pts:
            boxes = cluster.boxes(cluster.grid_clusters(rows, e, m)).where((F.col("end_a") + e >= F.col("start_b")) & (F.col("points") >= m))
            found.append(intervals.stitch(boxes.select(F.col("key").alias("chrom"), F.col("start_a").alias("start"), F.col("end_b").alias("end")), e))
    out = reduce(DataFrame.unionByName, found).select("chrom", "start", "end").distinct()
    return out.select(F.format_string("%s:%d-%d", "chrom", "start", "end").alias("peak_id"), "chrom", "start", "end", (F.col("end") - F.col("start") + 1).alias("length"))


def _shift(i: Column) -> tuple[Column, Column]:
    zero = F.lit(0).cast("long")
    return F.greatest(zero, F.col("start") - 1 + i * F.col("length")), F.greatest(zero, F.col("start") - 1 + (i + 1) * F.col("length"))


def around(points: DataFrame, peaks: DataFrame, reach: int, ext: int = 0) -> DataFrame:
    """``peaks`` with counts (pairs with both ends inside, grown by ``ext``), up, down (one length before and after) and near: a map from place to count of the neighbours up to ``reach`` lengths away, without zeros."""
    spans = [F.struct(F.lit("own").alias("what"), F.lit(0).alias("i"), (F.col("start") - ext).alias("start"), (F.col("end") + ext).alias("end"))]
    for what, sign in (("up", -1), ("down", 1)):
        spans.append(F.struct(F.lit(what).alias("what"), F.lit(0).alias("i"), (F.col("start") + sign * F.col("length")).alias("start"), (F.col("end") + sign * F.col("length")).alias("end")))
    for i in range(-reach, reach + 1):
        if i:
            start, end = _shift(F.lit(i))
            spans.append(F.struct(F.lit("near").alias("what"), F.lit(i).alias("i"), start.alias("start"), end.alias("end")))
    windows = peaks.select("peak_id", "chrom", F.explode(F.array(*spans)).alias("w")).select("chrom", "w.start", "w.end", F.struct("peak_id", "w.what", "w.i").alias("wid"))
    found = intervals.both_counts(points, windows, "wid").select("wid.*", "n")

    def only(what: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))

    # at most 2 * reach entries
    near = F.map_from_entries(F.collect_list(F.when(F.col("what") == "near", F.struct("i", "n"))))
    told = found.groupBy("peak_id").agg(only("own").alias("counts"), only("up").alias("up"), only("down").alias("down"), near.alias("near"))
    out = peaks.join(told, "peak_id", "left").fillna(0, ["counts", "up", "down"])
    return out.withColumn("near", F.coalesce("near", F.create_map().cast("map<int,bigint>")))


def _near(reach: int) -> Column:
    """Counts of all neighbours within ``reach``, ascending, with zeros."""
    return F.array_sort(F.array(*[F.coalesce(F.try_element_at("near", F.lit(i)), F.lit(0)) for i in range(-reach, reach + 1) if i]))


def near_mean(reach: int) -> Column:
    return F.aggregate(_near(reach), F.lit(0.0), lambda a, v: a + v) / (2 * reach)


def near_median(reach: int) -> Column:
    values = _near(reach)
    return (F.get(values, F.lit(reach - 1)) + F.get(values, F.lit(reach))) / 2


def summits(points: DataFrame, peaks: DataFrame, ext: int = 50) -> DataFrame:
    """peak_id and summit: the first position of the deepest cover by whole pairs inside the peak, grown by ``ext`` and cut at its ends."""
    inside = intervals.hits(points, "x", peaks.select("peak_id", "chrom", "start", "end")).where("y <= end")
    start, end = F.greatest(F.col("start"), F.col("x") - ext), F.least(F.col("end"), F.col("y") + ext)
    spans = inside.select(F.col("peak_id").alias("chrom"), start.alias("start"), end.alias("end")).where("start < end")
    deep = intervals.spans_depth(spans)
    return deep.groupBy(F.col("chrom").alias("peak_id")).agg(F.min_by("start", F.struct((-F.col("depth")).alias("d"), "start")).alias("summit"))


def per_base(points: DataFrame) -> DataFrame:
    return points.groupBy("chrom").agg((F.count(F.lit(1)) / F.nullif(F.max("y") - F.min("x"), F.lit(0))).alias("per_base"))


def rpkm(counts: Column, length: Column, total) -> Column:
    return counts / length / total * 1e9


def tested(points: DataFrame, peaks: DataFrame, total: int, min_pts: int, pcut: float = 0.01, least: int = 200, escut: float = 2.0, pseudo: float = 1.0, sensitive: bool = False,
           control: DataFrame | None = None, control_total: int = 0) -> DataFrame:
    """The peaks that stand out from their surroundings and the chromosome, with scores and p-values.

    ``escores`` and ``pvalues`` hold one for each of two surroundings and one for
    the chromosome. With a control, its counts, those around, and the ratio of RPKM
    (100 where the control has none) are added, and ratios below ``escut`` go.
    """
    reaches = (10, 20) if sensitive else (5, 10)
    pseudo = 0.0 if sensitive else pseudo
    rows = around(points, peaks, max(reaches)).where(F.col("counts") >= min_pts).join(F.broadcast(per_base(points)), "chrom")
    counts = F.col("counts").cast("double")
    expected = [F.least(near_mean(r), near_median(r)) if sensitive else near_mean(r) for r in reaches]
    chance = F.col("per_base") * F.col("length")
    scores = F.array(*[F.when(e > 0, counts / e).otherwise(counts) for e in expected], counts / chance)
    pvalues = F.array(*[tails.poisson_sf(counts, F.when(e > 0, e).otherwise(pseudo)) for e in expected], tails.poisson_sf(counts, chance))
    rows = rows.withColumns({"escores": scores, "density": rpkm(F.col("counts"), F.col("length"), total)}).where(F.array_min("escores") >= escut)
    rows = rows.withColumn("pvalues", pvalues)
    if control is not None:
        back = around(control, rows.select("peak_id", "chrom", "start", "end", "length"), max(reaches))
        local = F.array(*[F.least(near_mean(r), near_median(r)) if sensitive else near_mean(r) for r in reaches])
        back = back.select("peak_id", F.col("counts").alias("control_counts"), F.col("up").alias("control_up"), F.col("down").alias("control_down"), local.alias("control_local"))
        rows = rows.join(back, "peak_id").withColumn("control_density", rpkm(F.col("control_counts"), F.col("length"), control_total))
        rows = rows.withColumn("es_control", F.coalesce(F.try_divide("density", F.nullif("control_density", F.lit(0.0))), F.lit(100.0))).where(F.col("es_control") >= escut)
    extreme = F.array_min("pvalues") if sensitive else F.array_max("pvalues")
    rows = rows.where((extreme <= pcut) & (F.col("length") >= least)).checkpoint()
    return rows.join(summits(points, rows), "peak_id", "left").drop("near", "per_base")


def flank_factor(peaks: DataFrame) -> float:
    """The factor from control to target, fitted to both flanks of every peak in pairs per kilobase."""
    sides = F.explode(F.array(*[F.struct((F.col(s) / F.col("length") * 1000).alias("t"), (F.col(f"control_{s}") / F.col("length") * 1000).alias("c")) for s in ("up", "down")]))
    return estimates.scaling_factor(peaks.select(sides.alias("s")).select("s.*"), "t", "c")


def against_control(peaks: DataFrame, factor: float, pcut: float = 0.01, pseudo: float = 1.0, escut: float = 2.0) -> DataFrame:
    """Peaks that stand out from the scaled control."""
    expected = F.greatest(F.col("control_counts"), F.lit(pseudo)) * factor
    rows = peaks.withColumn("control_scaled", F.col("control_counts") * factor).withColumn("p_control", tails.poisson_sf(F.col("counts").cast("double"), expected))
    return rows.where((F.col("p_control") <= pcut) & ((F.col("control_scaled") == 0) | (F.col("counts") >= escut * F.col("control_scaled"))))


def corrected(peaks: DataFrame, pcut: float = 0.01) -> DataFrame:
    """Peaks whose p-values, times the number of peaks, are all within ``pcut``; p_mean is their harmonic mean. Sensitive calls are held to the same."""
    n = peaks.agg(F.count(F.lit(1)).cast("double").alias("_n"))  # one row
    rows = peaks.join(F.broadcast(n)).withColumn("pvalues", F.transform("pvalues", lambda p: p * F.col("_n")))
    values = F.col("pvalues")
    if "p_control" in peaks.columns:
        rows = rows.withColumn("p_control", F.col("p_control") * F.col("_n"))
        values = F.concat("pvalues", F.array("p_control"))
    rows = rows.where(F.array_max(values) <= pcut)
    return rows.withColumn("p_mean", tails.harmonic(values)).withColumn("significant", F.lit(1)).drop("_n")


def call(pets: DataFrame, eps: tuple[int, ...] = (100, 200), min_pts: tuple[int, ...] = (5,), pcut: float = 0.01, control: DataFrame | None = None, by_ratio: bool = False, sensitive: bool = False,
         split: bool = False, ext: int = 50) -> DataFrame:
    """Peaks of cis pairs, which are canonical and within the distances wanted; ``split`` takes every end as a tag of its own."""
    def prepared(p: DataFrame) -> DataFrame:
        points = intervals.points(p)
        return (tags(points, ext) if split else points).checkpoint()

    points = prepared(pets)
    total = points.count()
    found = candidates(points, eps, min_pts).checkpoint()
    if control is None:
        rows = tested(points, found, total, max(min_pts), pcut, max(eps), sensitive=sensitive).checkpoint()
    else:
        back = prepared(control)
        control_total = back.count()
        rows = tested(points, found, total, max(min_pts), pcut, max(eps), sensitive=sensitive, control=back, control_total=control_total).checkpoint()
        ratio = total / max(control_total, 1)
        fitted = ratio if by_ratio and not sensitive else flank_factor(rows)
        rows = against_control(rows, min(ratio, fitted) if sensitive else fitted, pcut, 0.0 if sensitive else 1.0).checkpoint()
    return corrected(selection.shortest_peaks(rows), pcut)
