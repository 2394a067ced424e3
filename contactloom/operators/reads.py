"""Raw reads before they are aligned: linkers, baits and fragments.

Reads are rows (name, seq, qual) or pairs (name, seq_a, qual_a, seq_b, qual_b), read
from FASTQ text. Aligners are other programs; their BED and BEDPE come back through
the readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactloom.operators import intervals
from contactloom.sources import tracks

#: The linker between ends, the seed that finds it, and the site of the enzyme pair.
LINKER, SEED, STARTS = "CTGTCTCTTATACACATCT", 9, ("CATG", "AATT", "NATG", "NATT")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq and qual of records of four lines each.

    Lines are numbered by file: a block's lines follow each other in one task, and what
    the blocks before it hold is added up. Qualities may begin like names, so nothing but
    the number tells them apart.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    line = F.col("ahead") + F.col("id") - F.col("first")
    rows = lines.join(ahead, ["file", "block"]).select("file", F.floor(line / 4).alias("record"), F.pmod(line, F.lit(4)).alias("part"), "value")
    of = {0: "name", 1: "seq", 3: "qual"}
    got = rows.groupBy("file", "record").agg(*[F.max(F.when(F.col("part") == i, F.col("value"))).alias(k) for i, k in of.items()])
    return got.where("qual IS NOT NULL").select(F.regexp_replace("name", "^@", "").alias("name"), "seq", "qual")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACTG", "TGAC"))


def linker_at(seq: Column, linker: str = LINKER) -> Column:
    """The first place from where ``SEED`` bases begin the linker or its reverse complement, -1 for none."""
    turned = linker[::-1].translate(str.maketrans("ACTG", "TGAC"))
    places = [F.locate(linker[:SEED], seq), F.locate(turned[:SEED], seq)]
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
    return F.coalesce(first - 1, F.lit(-1))


def cut_linkers(pairs: DataFrame, least: int = 10, linker: str = LINKER) -> DataFrame:
    """Pairs cut before the linker, named by number and both places of it; those with fewer than ``least`` bases on a side go."""
    at = tracks.numbered(pairs, "name").withColumns({f"at_{s}": linker_at(F.col(f"seq_{s}"), linker) for s in "ab"})
    cut = {f"{k}_{s}": F.expr(f"if(at_{s} < 0, {k}_{s}, left({k}_{s}, at_{s}))") for k in ("seq", "qual") for s in "ab"}
    out = at.withColumns(cut).withColumn("name", F.concat_ws("_", (F.col("i") + 1).cast("string"), F.col("at_a").cast("string"), F.col("at_b").cast("string")))
    return out.where((F.length("seq_a") >= least) & (F.length("seq_b") >= least)).select("name", "seq_a", "qual_a", "seq_b", "qual_b")


def starts_at_site(seq: Column) -> Column:
    return F.substring(seq, 1, 4).isin(*STARTS)


def mismatches(seq: Column, bait: str) -> Column:
    """Bases at which the beginning differs from the bait; a shorter read lacks the rest."""
    return sum((F.when(F.substring(seq, i + 1, 1) == c, 0).otherwise(1) for i, c in enumerate(bait)), F.lit(0))


def baited(reads: DataFrame, bait: str, site: str, miss: int = 2, least: int = 10) -> DataFrame:
    """What follows the first enzyme site after the bait, one base on, in reads that begin with the bait but for ``miss`` bases; more than ``least`` bases must be left."""
    at = F.locate(site, F.col("seq"), len(bait) + 1) - 1
    found = reads.where((F.length("seq") >= len(bait)) & (mismatches(F.col("seq"), bait) <= miss)).withColumn("_p", at).where("_p >= 0")
    cut = F.col("_p") + len(site) + 1
    # a site too near to the end rules out all later ones too
    kept = found.where(F.length("seq") - cut > least)
    return kept.select("name", *[F.substring(F.col(c), cut + 1, F.length(c)).alias(c) for c in ("seq", "qual")])


def unique_reads(reads: DataFrame, chrom: str | None = None, cis: bool = False) -> DataFrame:
    """One row for each (chrom, start, end); only of ``chrom`` if ``cis``."""
    kept = reads.where(F.col("chrom") == chrom) if cis and chrom is not None else reads
    return kept.dropDuplicates(["chrom", "start", "end"])


def read_counts(reads: DataFrame, chrom: str) -> DataFrame:
    """total, unique and cis (unique ones of ``chrom``)."""
    once = reads.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("c"))
    return once.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique"), F.count_if(F.col("chrom") == chrom).alias("cis"))


def fragments_of(reads: DataFrame, fragments: DataFrame) -> DataFrame:
    """The restriction fragment (chrom, start, end exclusive, name) that holds the 5' end of each read; the first of several."""
    five = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    tags = reads.select("chrom", five.alias("pos")).withColumn("rid", F.monotonically_increasing_id()).checkpoint()
    spans = fragments.select("chrom", "start", (F.col("end") - 1).alias("end"), "name")
    held = intervals.hits(tags, "pos", spans).groupBy("rid").agg(F.min(F.struct("chrom", "start", "end", "name")).alias("f"))
    return held.select("f.chrom", "f.start", (F.col("f.end") + 1).alias("end"), "f.name")


def read_coverage(reads: DataFrame, total: int, log: bool = False) -> DataFrame:
    """Depth of reads in runs, per million, or its log2 plus one: chrom, start, end, value."""
    value = F.col("depth") / total * 1e6
    return intervals.spans_depth(reads.select("chrom", "start", "end")).select("chrom", "start", "end", (F.log2(value + 1) if log else value).alias("value"))
