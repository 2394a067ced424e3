"""Given peaks, loops and domains, counted and tested in another sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions import tails
from contactloom.operators import domains as dom
from contactloom.operators import intervals, tiles
from contactloom.operators import loops as lp
from contactloom.operators import peaks as pk


def peaks(pets: DataFrame, regions: DataFrame, total: int, ext: int = 0) -> DataFrame:
    """Peaks (peak_id, chrom, start, end, length) with counts, density, escores and pvalues against medians around and the chromosome.

    Without pairs scores are 0 and p-values 1; where nothing is around, 100 and the floor.
    """
    points = intervals.points(pets)
    rows = pk.around(points, regions, 10, ext).join(F.broadcast(pk.per_base(points)), "chrom", "left")
    counts, chance = F.col("counts").cast("double"), F.col("per_base") * F.col("length")
    middles = [pk.near_median(r) for r in (5, 10)]
    scores = F.array(*[F.when(m > 0, counts / m).otherwise(100.0) for m in middles], F.try_divide(counts, F.nullif(chance, F.lit(0.0))))
    pvalues = F.array(*[F.when(m > 0, tails.poisson_sf(counts, m)).otherwise(tails.FLOOR) for m in middles], tails.poisson_sf(counts, chance))
    none = F.col("counts") == 0
    return rows.select(
        "peak_id", "chrom", "start", "end", "length", "counts", F.when(none, 0.0).otherwise(pk.rpkm(F.col("counts"), F.col("length"), total)).alias("density"),
        F.when(none, F.array(*[F.lit(0.0)] * 3)).otherwise(scores).alias("escores"), F.when(none, F.array(*[F.lit(1.0)] * 3)).otherwise(pvalues).alias("pvalues"),
    )


def loops(pets: DataFrame, known: DataFrame, total: int, counts_only: bool = False, pseudo: float = 1.0) -> DataFrame:
    """Loops with ra, rb, rab, p2ll (against the neighbour down both axes) and density; unless ``counts_only`` also es, fdr and all p-values."""
    points = intervals.points(pets)
    rows = lp.counted(points, known, before=True).withColumn("p2ll", F.col("rab") / F.greatest(F.col("lower"), F.lit(pseudo)))
    density = F.coalesce(F.try_divide(F.col("rab").cast("double"), F.expr("end_a - start_a + end_b - start_b")) / total * 1e9, F.lit(0.0))
    rows = rows.withColumn("density", density)
    own = [c for c in known.columns if c not in ("ra", "rb", "rab", "p2ll", "density")]
    if counts_only:
        ones = ["fdr", "hypergeometric_p", "poisson_p", "binomial_p", "p_a", "p_b"]
        return rows.select(*own, "ra", "rb", "rab", "p2ll", "density", *[F.lit(0.0).alias(c) for c in ("es", "es_a", "es_b")], *[F.lit(1.0).alias(c) for c in ones])
    rows = rows.join(F.broadcast(lp.totals(points)), "chrom", "left").checkpoint()
    rows = lp._outcome(rows.join(tiles.background(points, rows, 5), "loop_id", "left"), 5, False)
    some, rab = F.col("rab") > 0, F.col("rab").cast("double")
    around = F.when(F.col("around") > 0, F.col("around")).otherwise(pseudo)
    dense = F.when(F.col("around_density") > 0, F.col("around_density")).otherwise(1e-10)
    told = {
        "es": F.when(some, rab / around).otherwise(0.0), "fdr": F.when(some, F.col("fdr")).otherwise(1.0), "hypergeometric_p": lp.hypergeometric(F.col("all_pairs")),
        "poisson_p": tails.poisson_sf(rab, around), "binomial_p": tails.binomial_sf(rab, (F.col("ra") * F.col("rb") - F.col("rab")).cast("double"), dense),
    }
    tested = lp.anchor_test(rows.withColumns(told))
    return tested.select(*own, "ra", "rb", "rab", "p2ll", "density", "es", "es_a", "es_b", "fdr", "hypergeometric_p", "poisson_p", "binomial_p", "p_a", "p_b")


def domains(pets: DataFrame, known: DataFrame, total: int, size: int = 10_000, window: int = 500_000) -> DataFrame:
    """Domains (chrom, start, end, length) with pairs inside and across, es (infinite where none is across), density and the mean score ss."""
    rows = dom.tested(pets, known.select("chrom", "start", "end", "length"), total, empty=float("inf")).drop("significant")
    return rows.join(dom.mean_scores(dom.segregation(pets, size, window), rows, size, window), "domain_id", "left")


def regions(pets: DataFrame, known: DataFrame) -> DataFrame:
    """Tags of regions (region_id, chrom, start, end): local (both ends inside, two each), distal, all, and their RPKM by the pairs of the chromosome.

    The RPKM of distal tags counts each pair twice, as that of local ones does.
    """
    n = intervals.points(pets).groupBy("chrom").agg(F.count(F.lit(1)).alias("_n"))
    rows = intervals.region_counts(pets, known).join(F.broadcast(n), "chrom")
    local, distal = F.col("both_ends") * 2, F.col("distal")
    told = {"all_pets": local + distal, "local_pets": local, "distal_pets": distal}

    def rpkm(tags):
        return F.try_divide(tags.cast("double"), F.expr("end - start")) / F.col("_n") / 2 * 1e9

    return rows.select("region_id", "chrom", "start", "end", *[c.alias(k) for k, c in told.items()], rpkm(local + distal).alias("all_rpkm"), rpkm(local).alias("local_rpkm"), rpkm(distal * 2).alias("distal_rpkm"))


def share_in_regions(pets: DataFrame, known: DataFrame, single: bool = False) -> DataFrame:
    """hits and pets: pairs with both ends (``single``: any end) in each region, added up, and all pairs."""
    counts = intervals.window_counts(intervals.points(pets), known.select("region_id", "chrom", "start", "end"), "region_id")
    hits = counts.agg(F.coalesce(F.sum("any_end" if single else "both_ends"), F.lit(0)).alias("hits"))
    return hits.withColumn("pets", F.lit(pets.count()).cast("long"))
