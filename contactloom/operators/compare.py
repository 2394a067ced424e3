"""Two samples side by side: compartments by bins and domains by their enrichment, and what is specific to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions import tails
from contactloom.operators import domains as dom
from contactloom.operators import intervals


def compartment_bins(a: DataFrame, b: DataFrame, pcut: float = 0.01) -> DataFrame:
    """Bins (chrom, start, end, value) of both signals: value_a, value_b, d2, p and flip (AtoB, BtoA, AtoA, BtoB) where p is below ``pcut``."""
    both = a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), ["chrom", "start", "end"])
    rows = tails.two_pass_mahalanobis(both, "value_a", "value_b", pcut)
    va, vb = F.col("value_a"), F.col("value_b")
    side = {"A": lambda v: v > 0, "B": lambda v: v < 0}
    flip = F.lit(None).cast("string")
    for x in "AB":
        for y in "AB":
            flip = F.when(side[x](va) & side[y](vb), f"{x}to{y}").otherwise(flip)
    return rows.withColumn("flip", F.when(F.col("p") < pcut, flip))


def annotated_bins(bins: DataFrame, compartments: DataFrame, genes: DataFrame) -> DataFrame:
    """Changed bins with the compartment that holds their start and the genes (gene_id, chrom, start, end) they overlap, sorted."""
    rows = bins.withColumn("region_id", F.struct("chrom", "start", "end"))
    runs = compartments.select("chrom", "start", (F.col("end") - 1).alias("end"), F.format_string("%s:%d-%d|compartment%s", "chrom", "start", "end", "compartment").alias("compartment"))
    held = intervals.hits(rows.select("chrom", F.col("start").alias("pos"), "region_id"), "pos", runs).select("region_id", "compartment")
    met = overlapping_genes(rows, genes)
    return rows.join(held, "region_id", "left").join(met, "region_id", "left").drop("region_id")


def overlapping_genes(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """region_id and the genes that overlap it; ends are exclusive."""
    r = regions.select("region_id", "chrom", "start", (F.col("end") - 1).alias("end"))
    g = genes.select(F.col("gene_id").alias("region_id"), "chrom", "start", (F.col("end") - 1).alias("end"))
    return intervals.overlaps(r, g, same=False).groupBy(F.col("id_a").alias("region_id")).agg(F.array_sort(F.collect_set("id_b")).alias("genes"))


def domain_measures(pets: DataFrame, domains: DataFrame, total: int) -> DataFrame:
    """domain_id, total, internal, external, es (null where nothing is external), and RPKM inside and across."""
    rows = dom.tested(pets, domains.select("chrom", "start", "end", (F.col("end") - F.col("start")).alias("length")), total, empty=None)
    external = F.col("total_pets") - F.col("within_pets")
    return rows.select(
        "domain_id", "chrom", "start", "end", F.col("total_pets").alias("total"), F.col("within_pets").alias("internal"), external.alias("external"), "es",
        F.col("density").alias("internal_rpkm"), (external / F.col("length") / total * 1e9).alias("external_rpkm"),
    )


def domains(a: DataFrame, b: DataFrame, known: DataFrame, pcut: float = 0.01) -> DataFrame:
    """The measures of every domain in both samples (suffixes _a and _b), d2 and p of its two enrichments, and specific: a, b or null."""
    measures = ("total", "internal", "external", "es", "internal_rpkm", "external_rpkm")
    out = domain_measures(a, known, a.count()).withColumnsRenamed({m: f"{m}_a" for m in measures})
    other = domain_measures(b, known, b.count()).select("domain_id", *[F.col(m).alias(f"{m}_b") for m in measures])
    rows = tails.two_pass_mahalanobis(out.join(other, "domain_id").where("es_a IS NOT NULL AND es_b IS NOT NULL"), "es_a", "es_b", pcut)
    side = F.when(F.col("es_a") > F.col("es_b"), "a").when(F.col("es_b") > F.col("es_a"), "b")
    return rows.withColumn("specific", F.when(F.col("p") < pcut, side))
