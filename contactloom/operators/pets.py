"""Canonical orientation, filters, deduplication, merging, sampling and quality counts of paired tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distances up to which a pair is close, and middle.
CLOSE, MIDDLE = 1_000, 10_000


def canonical(raw: DataFrame) -> DataFrame:
    """Ends in order: by position within a chromosome, by name between two. Adds key, x, y, dist (null for trans)."""
    cis = F.col("chrom_a") == F.col("chrom_b")
    swap = F.when(cis, F.col("pos_a") > F.col("pos_b")).otherwise(F.col("chrom_a") > F.col("chrom_b"))

    def either(a: str, b: str) -> Column:
        return F.when(swap, F.col(b)).otherwise(F.col(a))

    out = raw.withColumns({
        "chrom_a": either("chrom_a", "chrom_b"), "chrom_b": either("chrom_b", "chrom_a"), "x": either("pos_a", "pos_b"), "y": either("pos_b", "pos_a"),
        "strand_a": either("strand_a", "strand_b"), "strand_b": either("strand_b", "strand_a"),
    }).drop("pos_a", "pos_b")
    return out.withColumns({"key": F.concat_ws("-", "chrom_a", "chrom_b"), "dist": F.when(F.col("chrom_a") == F.col("chrom_b"), F.col("y") - F.col("x"))})


def keep(pets: DataFrame, mapq: int = 0, chroms: tuple[str, ...] = (), cut: int = 0, mcut: int = -1, cis_only: bool = False) -> DataFrame:
    """Quality, chromosomes of both ends, distance limits (inclusive, cis only) and kind."""
    out = pets.where(F.col("mapq") >= mapq)
    if chroms:
        out = out.where(F.col("chrom_a").isin(*chroms) & F.col("chrom_b").isin(*chroms))
    trans = F.col("dist").isNull()
    if cut > 0:
        out = out.where(trans | (F.col("dist") >= cut))
    if mcut > 0:
        out = out.where(trans | (F.col("dist") <= mcut))
    return out.where(~trans) if cis_only else out


def unique(pets: DataFrame) -> DataFrame:
    """One row for each pair of positions: key, chrom_a, chrom_b, x, y, dist."""
    return pets.select("key", "chrom_a", "chrom_b", "x", "y", "dist").distinct()


def combine(libraries: list[DataFrame], copies: int = 1) -> DataFrame:
    """All libraries with at most ``copies`` of each pair (0: all of them)."""
    rows = reduce(DataFrame.unionByName, [d.select("key", "x", "y") for d in libraries])
    if not copies:
        return rows
    # counts combine before the shuffle, so that no pair fills a task
    counted = rows.groupBy("key", "x", "y").agg(F.least(F.count(F.lit(1)), F.lit(copies)).alias("n"))
    return counted.select("key", "x", "y", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")


def sample(pets: DataFrame, share: float) -> DataFrame:
    """The pairs whose hash falls below the share: the same ones at every run."""
    word = F.concat_ws(":", "key", F.col("x").cast("string"), F.col("y").cast("string"))
    return pets.where(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("double") < share * 2.0**32)


def _swapped(raw: DataFrame) -> Column:
    cis = F.col("chrom_a") == F.col("chrom_b")
    return F.when(cis, F.col("pos_a") > F.col("pos_b")).otherwise(F.col("chrom_a") > F.col("chrom_b"))


def quality(raw: DataFrame, by: str = "library") -> DataFrame:
    """Counts and ratios of each library before any filter.

    Pairs are the same if both intervals (start_a ... end_b, where ``raw`` has them;
    positions otherwise) and strands are.
    """
    spans = "start_a" in raw.columns
    out = canonical(raw)
    same = [by, "chrom_a", "chrom_b", "strand_a", "strand_b", *(["s_a", "e_a", "s_b", "e_b"] if spans else ["x", "y"])]
    if spans:
        swap = _swapped(raw)
        ends = {f"{k[0]}_{s}": F.when(swap, F.col(f"{k}_{t}")).otherwise(F.col(f"{k}_{s}")) for k in ("start", "end") for s, t in (("a", "b"), ("b", "a"))}
        out = canonical(raw.withColumns(ends))
    once = out.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"), F.first("dist").alias("dist"))
    cis = F.col("dist").isNotNull()

    def number(test: Column) -> Column:
        return F.count_if(test)

    counts = once.groupBy(by).agg(
        F.sum("copies").alias("total_pets"), F.count(F.lit(1)).alias("unique_pets"), number(cis).alias("cis"), number(~cis).alias("trans"),
        F.coalesce(F.round(F.avg("dist"), 6), F.lit(0.0)).alias("mean_distance"),
        number(F.col("dist") <= CLOSE).alias("close_pets"), number((F.col("dist") > CLOSE) & (F.col("dist") <= MIDDLE)).alias("middle_pets"),
        number(F.col("dist") > MIDDLE).alias("distal_pets"), number(cis & (F.col("strand_a") != F.col("strand_b"))).alias("opposite_pets"),
        number(cis & (F.col("strand_a") == "+") & (F.col("strand_b") == "+")).alias("forward_pets"), number(cis & (F.col("strand_a") == "-") & (F.col("strand_b") == "-")).alias("reverse_pets"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)

    return counts.withColumns({
        "redundancy": F.round(1 - F.col("unique_pets") / F.col("total_pets"), 6), "cis_ratio": ratio("cis", "unique_pets"),
        "trans_ratio": ratio("trans", "unique_pets"), "close_ratio": ratio("close_pets", "cis"), "middle_ratio": ratio("middle_pets", "cis"),
        "distal_ratio": ratio("distal_pets", "cis"),
    })


def ingest_counts(pets: DataFrame, mapq: int = 0, chroms: tuple[str, ...] = (), cut: int = 0, mcut: int = -1, cis_only: bool = False) -> DataFrame:
    """What the filters of ``keep`` do to canonical pairs, in one row, with the unique pairs and the redundancy of cis pairs.

    The redundancy is one minus unique over all cis pairs that the distance limits leave.
    """
    rows = pets.where(F.col("chrom_a").isin(*chroms) & F.col("chrom_b").isin(*chroms)) if chroms else pets
    good, cis = F.col("mapq") >= mapq, F.col("dist").isNotNull()
    close = good & cis & (F.col("dist") < cut) if cut > 0 else F.lit(False)
    far = good & cis & (F.col("dist") > mcut) if mcut > 0 else F.lit(False)
    kept = good & ~F.coalesce(close, F.lit(False)) & ~F.coalesce(far, F.lit(False)) & (cis if cis_only else F.lit(True))
    # copies of a pair combine first, so that uniques need no second pass
    once = rows.groupBy("key", "x", "y").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("good"), F.count_if(good & cis).alias("cis"), F.count_if(good & ~cis).alias("trans"),
        F.count_if(close).alias("close"), F.count_if(far).alias("far"), F.count_if(kept).alias("kept"),
    )
    told = once.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_pets") for c in ("total", "good", "cis", "trans", "close", "far")],
                    F.count_if(F.col("kept") > 0).alias("unique_pets"), F.count_if((F.col("kept") > 0) & (F.col("cis") > 0)).alias("_u"), F.sum(F.when(F.col("cis") > 0, F.col("kept"))).alias("_k"))
    return told.withColumn("cis_redundancy", F.round(1 - F.try_divide("_u", "_k"), 6)).drop("_u", "_k")


def catalog(pets: DataFrame) -> DataFrame:
    """key, cis (both chromosomes are one), pets, and the extent of every key."""
    return pets.groupBy("key", (F.col("chrom_a") == F.col("chrom_b")).alias("cis")).agg(F.count(F.lit(1)).alias("pets"), F.min("x").alias("min_x"), F.max("y").alias("max_y"))


def sample_to(pets: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """About ``total`` of the unique pairs, by hash: a share of them, or, for more than there are, every pair as often as the ratio says.

    A ratio of 2.3 gives two copies of each pair and a third of 30 %; the same ones at every run.
    """
    have = pets.count()
    if not have or total <= 0:
        return pets.limit(0)
    ratio = total / have
    u = (F.pmod(F.xxhash64(F.lit(seed), "key", "x", "y"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    copies = F.lit(int(ratio)) + (u < ratio - int(ratio)).cast("int")
    return pets.withColumn("_c", copies).where("_c > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_c")
