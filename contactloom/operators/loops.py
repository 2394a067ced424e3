"""Loops within and between chromosomes: candidates from clusters, tests against moved anchors, marks, choice.

Loops are (loop_id, chrom, start_a, end_a, start_b, end_b); between chromosomes
``chrom`` is the key of both. Tests come in stages, cheap ones first, so that the
tiles around a loop are only counted for those that may pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import tails
from contactloom.operators import cluster, intervals, selection, tiles

BOX = ("start_a", "end_a", "start_b", "end_b")


def trans_points(pets: DataFrame) -> DataFrame:
    """Pairs between chromosomes as (chrom, x, y), named by their key."""
    return pets.where("dist IS NULL").select(F.col("key").alias("chrom"), "x", "y")


def _identified(boxes: DataFrame) -> DataFrame:
    """Distinct boxes with an id made of their place."""
    id = F.format_string("%s:%d-%d|%d-%d", "chrom", *BOX)
    return boxes.select("chrom", *BOX).distinct().select(id.alias("loop_id"), "chrom", *BOX)


def _width(side: str) -> Column:
    return F.col(f"end_{side}") - F.col(f"start_{side}")


def distance() -> Column:
    return F.abs((F.col("start_b") + F.col("end_b")) / 2 - (F.col("start_a") + F.col("end_a")) / 2)


def candidates(points: DataFrame, eps: tuple[int, ...], min_pts: tuple[int, ...], paired: bool = False, exact: bool = False, trans: bool = False, least: int = 200) -> DataFrame:
    """Boxes of clusters of every combination (or, ``paired``, of places) of eps and min_pts, once each.

    Within chromosomes both anchors together are ``least`` long and do not overlap.
    """
    rows = points.select(F.col("chrom").alias("key"), "x", "y")
    how = cluster.exact_clusters if exact else cluster.grid_clusters
    settings = list(zip(eps, min_pts, strict=True)) if paired else [(e, m) for e in eps for m in min_pts]
    boxes = reduce(DataFrame.unionByName, [cluster.boxes(how(rows, e, m)) for e, m in settings]).withColumnRenamed("key", "chrom")
    return _identified(boxes if trans else boxes.where((_width("a") + _width("b") >= least) & (F.col("end_a") < F.col("start_b"))))


def lower_left(before: bool) -> dict[str, Column]:
    """The neighbour between the anchors (a moved up, b down), or, ``before``, that of both anchors moved down."""
    a = {"start_a": F.col("start_a") - _width("a"), "end_a": F.col("start_a")} if before else {"start_a": F.col("end_a"), "end_a": F.col("end_a") + _width("a")}
    return a | {"start_b": F.col("start_b") - _width("b"), "end_b": F.col("start_b")}


def counted(points: DataFrame, loops: DataFrame, before: bool = False, ext: int = 5) -> DataFrame:
    """``loops`` with ra, rb, rab, lower (pairs of the lower-left neighbour), wide_a and wide_b (pairs with an end within ``ext`` lengths of an anchor's middle)."""
    low = lower_left(before)
    rects = loops.select("loop_id", "chrom", F.lit("rab").alias("what"), *BOX).unionByName(loops.select("loop_id", "chrom", F.lit("lower").alias("what"), *[low[c].alias(c) for c in BOX]))
    joined = intervals.rectangle_counts(points, rects.withColumn("wid", F.struct("loop_id", "what")), "wid").select("wid.*", "n")
    spans = []
    for s in "ab":
        mid, length = (F.col(f"start_{s}") + F.col(f"end_{s}")) / 2, _width(s)
        spans.append(F.struct(F.lit(f"r{s}").alias("what"), F.col(f"start_{s}").alias("start"), F.col(f"end_{s}").alias("end")))
        start = F.ceil(F.greatest(F.lit(0.0), mid - ext * length)).cast("long")
        spans.append(F.struct(F.lit(f"wide_{s}").alias("what"), start.alias("start"), F.floor(mid + ext * length).cast("long").alias("end")))
    windows = loops.select("loop_id", "chrom", F.explode(F.array(*spans)).alias("w")).select("chrom", "w.start", "w.end", F.struct("loop_id", "w.what").alias("wid"))
    seen = intervals.window_counts(points, windows, "wid").select("wid.*", F.col("any_end").alias("n"))
    names = ["ra", "rb", "rab", "lower", "wide_a", "wide_b"]
    wide = joined.unionByName(seen).groupBy("loop_id").pivot("what", names).agg(F.sum("n"))
    return loops.join(wide, "loop_id", "left").fillna(0, names)


def totals(points: DataFrame) -> DataFrame:
    """chrom, all pairs and pairs per base: one row a label."""
    return points.groupBy("chrom").agg(F.count(F.lit(1)).alias("all_pairs"), (F.count(F.lit(1)) / F.nullif(F.max("y") - F.min("x"), F.lit(0))).alias("per_base"))


def anchor_test(loops: DataFrame, ext: int = 5) -> DataFrame:
    """Adds es_a, p_a, es_b, p_b: each anchor as a peak, against its surroundings, the chromosome's mean and 1."""
    for s in "ab":
        n = F.col(f"r{s}")
        expected = F.greatest((F.col(f"wide_{s}") - n) / ext / 2, F.col("per_base") * _width(s), F.lit(1.0))
        loops = loops.withColumns({f"es_{s}": n / expected, f"p_{s}": tails.poisson_sf(n.cast("double"), expected)})
    return loops


def _outcome(loops: DataFrame, reach: int, mean: bool) -> DataFrame:
    """Adds the middle of tiles and densities, and fdr, the share of tiles that hold more than the loop."""
    n = 4 * reach * reach
    of = tiles.padded_mean if mean else tiles.padded_median
    filled = loops.withColumns({c: F.coalesce(c, F.array().cast(f"array<{t}>")) for c, t in (("tiles", "bigint"), ("densities", "double"))})
    return filled.withColumns({
        "around": of(F.col("tiles"), n), "around_density": of(F.col("densities"), n), "fdr": F.size(F.filter("tiles", lambda v: v > F.col("rab"))) / F.lit(float(n)),
    })


def _ratio_within(a: Column, b: Column, cut: float) -> Column:
    return (a <= b * cut) & (b <= a * cut)


def hypergeometric(total: Column) -> Column:
    return tails.hypergeometric_sf(*[c.cast("double") for c in (F.col("rab"), total, F.col("ra"), F.col("rb"))])


def density(total) -> Column:
    return F.col("rab") / (_width("a") + _width("b")) / total * 1e9


def cis_tests(points: DataFrame, loops: DataFrame, total: int, min_pts: int = 5, hic: bool = False, reach: int = 5, pseudo: float = 1.0, ratio: float = 20.0, pcut: float = 1e-5) -> DataFrame:
    """The loops that may be significant, with all counts and tests.

    A loop goes where anchors differ too much in width or pairs, hold no pairs of
    others, hold fewer than ``min_pts`` common ones, or fail a test by far.
    """
    first = loops.where(_ratio_within(_width("a"), _width("b"), ratio))
    first = counted(points, first).where((F.col("rab") >= min_pts) & (F.col("ra") != F.col("rab")) & (F.col("rb") != F.col("rab")) & _ratio_within(F.col("ra"), F.col("rb"), ratio))
    first = first.join(F.broadcast(totals(points)), "chrom").withColumn("p2ll", F.col("rab") / F.greatest(F.col("lower"), F.lit(pseudo)))
    if hic:
        first = first.where("p2ll >= 1")
    first = first.withColumn("hypergeometric_p", hypergeometric(F.col("all_pairs"))).where("hypergeometric_p <= 1e-2").checkpoint()
    second = _outcome(first.join(tiles.background(points, first, reach), "loop_id", "left"), reach, False)
    second = second.where("around < rab AND fdr < 0.1").withColumn("es", F.col("rab") / F.greatest("around", F.lit(pseudo))).where("es >= 1")
    rab = F.col("rab").cast("double")
    second = second.withColumns({
        "poisson_p": tails.poisson_sf(rab, F.col("around")),
        "binomial_p": tails.binomial_sf(rab, (F.col("ra") * F.col("rb") - F.col("rab")).cast("double"), F.col("around_density")), "density": density(total),
    })
    third = anchor_test(second)
    third = third if hic else third.where(f"p_a < {pcut} AND p_b < {pcut}")
    return third.drop("tiles", "densities", "wide_a", "wide_b", "lower", "per_base", "all_pairs", "around_density")


def marked_cis(loops: DataFrame, hic: bool = False) -> DataFrame:
    fits = "fdr <= 0.05 AND es >= 2 AND hypergeometric_p <= 1e-5 AND poisson_p <= 1e-5 AND binomial_p < " + ("1e-3" if hic else "1e-1")
    return loops.withColumn("significant", F.expr(fits).cast("int"))


def trans_tests(points: DataFrame, loops: DataFrame, min_pts: int = 5, reach: int = 5, pseudo: float = 1.0, ratio: float = 10.0) -> DataFrame:
    """All counts and tests of loops between chromosomes, against the mean of the moved anchors."""
    first = loops.where(_ratio_within(_width("a"), _width("b"), ratio))
    first = counted(points, first, before=True).where((F.col("rab") >= min_pts) & _ratio_within(F.col("ra"), F.col("rb"), ratio))
    first = first.join(F.broadcast(totals(points)), "chrom").checkpoint()
    out = _outcome(first.join(tiles.background(points, first, reach), "loop_id", "left"), reach, True)
    rab = F.col("rab").cast("double")
    out = anchor_test(out).withColumns({
        "p2ll": F.col("rab") / F.greatest(F.col("lower"), F.lit(pseudo)), "es": F.col("rab") / F.greatest("around", F.lit(pseudo)),
        "hypergeometric_p": hypergeometric(F.col("all_pairs")), "poisson_p": tails.poisson_sf(rab, F.col("around")),
        "binomial_p": tails.binomial_sf(rab, (F.col("ra") * F.col("rb")).cast("double"), F.col("around_density")), "density": density(F.col("all_pairs")),
    })
    return out.drop("tiles", "densities", "wide_a", "wide_b", "lower", "per_base", "all_pairs", "around_density")


def marked_trans(loops: DataFrame) -> DataFrame:
    return loops.withColumn("significant", F.expr("binomial_p <= 1e-10 AND fdr <= 0.05 AND es >= 2").cast("int"))


def call_cis(pets: DataFrame, eps: tuple[int, ...], min_pts: tuple[int, ...], cut: int = 0, hic: bool = False, paired: bool = False) -> DataFrame:
    """Loops within chromosomes. ``pets`` are canonical and once each; loops not further apart than ``cut`` go."""
    points = intervals.points(pets).checkpoint()
    found = candidates(points, eps, min_pts, paired, hic).where(distance() > cut).checkpoint()
    tested = marked_cis(cis_tests(points, found, pets.count(), max(min_pts), hic), hic).where("significant = 1").checkpoint()
    return selection.best_loops(tested)


def call_trans(pets: DataFrame, eps: tuple[int, ...], min_pts: tuple[int, ...]) -> DataFrame:
    """Loops between chromosomes."""
    points = trans_points(pets).checkpoint()
    found = candidates(points, eps, min_pts, trans=True).checkpoint()
    return selection.best_loops(marked_trans(trans_tests(points, found, max(min_pts))).where("significant = 1").checkpoint())


def on_anchors(pets: DataFrame, loops: DataFrame, margin: int) -> DataFrame:
    """Cis pairs with any end in the stitched anchors of the loops."""
    return intervals.touching(pets, intervals.anchors(loops), gap=margin)
