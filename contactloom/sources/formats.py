"""Readers of the text formats for paired tags, intervals, genes, loops, domains, networks and signals, and conversions between pair formats.

Everything is one ``spark.read.text`` scan with expressions on top; gzip is read as
it is. Rows with the wrong number of fields or with coordinates that are no numbers
are dropped, as are header lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of pairs that count.
PAIR_TYPES = ("UU", "MR", "MU", "RU", "UR")


def _fields(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    return rows.select(F.split("value", sep).alias("f"))


def _at(i: int, kind: str = "string") -> Column:
    value = F.get("f", F.lit(i))
    return value if kind == "string" else value.try_cast(kind)


def _whole(i: int) -> Column:
    """A coordinate that may be written with a fraction."""
    return _at(i, "double").cast("long")


def bedpe_rows(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """Paired intervals: chrom_a, start_a, end_a, chrom_b, start_b, end_b, mapq (255 where it is no number), strands, and the name."""
    rows = _fields(spark, path).where(F.size("f") >= least)
    spans = [_at(i, "long").alias(k) for i, k in ((1, "start_a"), (2, "end_a"), (4, "start_b"), (5, "end_b"))]
    out = rows.select(_at(0).alias("chrom_a"), _at(3).alias("chrom_b"), *spans, _at(6).alias("name"), F.coalesce(_at(7, "int"), F.lit(255)).alias("mapq"), _at(8).alias("strand_a"), _at(9).alias("strand_b"))
    return out.where("start_a IS NOT NULL AND end_a IS NOT NULL AND start_b IS NOT NULL AND end_b IS NOT NULL")


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """Paired ends at the middle of each interval; quality 255 where it is no number."""
    return bedpe_rows(spark, path).select(
        "chrom_a", F.expr("(start_a + end_a) div 2").alias("pos_a"), "chrom_b", F.expr("(start_b + end_b) div 2").alias("pos_b"), "mapq", "strand_a", "strand_b"
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Seven columns, or eight with a kind of pair that counts."""
    rows = _fields(spark, path).where((F.size("f") == 7) | ((F.size("f") == 8) & _at(7).isin(*PAIR_TYPES)))
    return rows.select(
        _at(1).alias("chrom_a"), _at(2, "long").alias("pos_a"), _at(3).alias("chrom_b"), _at(4, "long").alias("pos_b"),
        F.lit(255).alias("mapq"), _at(5).alias("strand_a"), _at(6).alias("strand_b"),
    ).where("pos_a IS NOT NULL AND pos_b IS NOT NULL")


def read_valid_pairs(spark: SparkSession, path: str) -> DataFrame:
    """name, chromosome, position and strand of each end."""
    return _fields(spark, path).where(F.size("f") >= 7).select(
        _at(0).alias("name"), _at(1).alias("chrom_a"), _at(2, "long").alias("pos_a"), _at(4).alias("chrom_b"), _at(5, "long").alias("pos_b"),
        F.lit(255).alias("mapq"), _at(3).alias("strand_a"), _at(6).alias("strand_b"),
    ).where("pos_a IS NOT NULL AND pos_b IS NOT NULL")


def read_juicer_long(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated: strand, chromosome, position, fragment of each end; strand 0 is +."""
    return _fields(spark, path, " +").where(F.size("f") >= 7).select(
        _at(1).alias("chrom_a"), _at(2, "long").alias("pos_a"), _at(5).alias("chrom_b"), _at(6, "long").alias("pos_b"),
        F.lit(255).alias("mapq"), F.when(_at(0) == "0", "+").otherwise("-").alias("strand_a"), F.when(_at(4) == "0", "+").otherwise("-").alias("strand_b"),
    ).where("pos_a IS NOT NULL AND pos_b IS NOT NULL")


BEDPE = ("chrom_a", "start_a", "end_a", "chrom_b", "start_b", "end_b", "name", "score", "strand_a", "strand_b")


def valid_pairs_to_bedpe(rows: DataFrame, ext: int = 50) -> DataFrame:
    """Positions are 5' ends: each interval goes on ``ext`` along its strand."""
    spans = []
    for s in "ab":
        pos, plus = F.col(f"pos_{s}"), F.col(f"strand_{s}") == "+"
        spans += [F.when(plus, pos).otherwise(pos - ext).alias(f"start_{s}"), F.when(plus, pos + ext).otherwise(pos).alias(f"end_{s}")]
    return rows.select("*", *spans, F.lit(".").alias("score")).select(*BEDPE)


def juicer_long_to_bedpe(rows: DataFrame, ext: int = 50) -> DataFrame:
    """``ext`` to both sides of each position, cut at zero."""
    spans = [c for s in "ab" for c in (F.greatest(F.lit(0), F.col(f"pos_{s}") - ext).alias(f"start_{s}"), (F.col(f"pos_{s}") + ext).alias(f"end_{s}"))]
    return rows.select("*", *spans, F.lit(".").alias("name"), F.lit(".").alias("score")).select(*BEDPE)


def bed_to_bedpe(rows: DataFrame, ext: int = 150) -> DataFrame:
    """Single reads (chrom, start, end, strand) as pairs with what lies ``ext`` on along their strand; no strand counts as +."""
    plus = F.coalesce(F.col("strand") == "+", F.lit(True))
    zero = F.lit(0)
    return rows.select(
        F.col("chrom").alias("chrom_a"), F.when(plus, F.col("start")).otherwise(F.greatest(zero, F.col("start"))).alias("start_a"),
        F.when(plus, F.col("end")).otherwise(F.greatest(zero, F.col("end") - ext)).alias("end_a"), F.col("chrom").alias("chrom_b"),
        F.when(plus, F.col("start") + ext).otherwise(F.col("start")).alias("start_b"), F.when(plus, F.col("end") + ext).otherwise(F.col("end")).alias("end_b"),
        F.lit(".").alias("name"), F.lit("44").alias("score"), F.lit("+").alias("strand_a"), F.lit("-").alias("strand_b"),
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name (null in three columns), strand (null before the sixth) and region_id: the first fields, up to the name."""
    return _fields(spark, path).where(F.size("f") >= 3).select(
        _at(0).alias("chrom"), _at(1, "long").alias("start"), _at(2, "long").alias("end"), _at(3).alias("name"), _at(5).alias("strand"),
        F.concat_ws("|", F.slice("f", 1, 4)).alias("region_id"),
    ).where("start IS NOT NULL AND end IS NOT NULL")


def contained(regions: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """The regions that lie within a window."""
    return regions.where((F.col("chrom") == chrom) & (F.col("start") >= start) & (F.col("end") <= end))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end and the last field as value."""
    return _fields(spark, path).where(F.size("f") >= 4).select(
        _at(0).alias("chrom"), _at(1, "long").alias("start"), _at(2, "long").alias("end"), F.element_at("f", -1).try_cast("double").alias("value")
    ).where("start IS NOT NULL AND end IS NOT NULL AND value IS NOT NULL")


def _attribute(name: str) -> Column:
    return F.regexp_extract(_at(8), rf'(?:^|; ?){name} "?([^";]*)"?', 1)


def read_exons(spark: SparkSession, path: str, transcripts: bool = False) -> DataFrame:
    """Exons with the id and name of their gene, or of their transcript (where it has no name, with that of the gene)."""
    rows = _fields(spark, path).where((F.size("f") >= 9) & (_at(2) == "exon"))
    name = _attribute("gene_name")
    id = _attribute("transcript_id" if transcripts else "gene_id")
    if transcripts:
        own = _attribute("transcript_name")
        name = F.when(own == "", name).otherwise(own)
    return rows.select(_at(0).alias("chrom"), _at(3, "long").alias("start"), _at(4, "long").alias("end"), _at(6).alias("strand"), id.alias("gene_id"), name.alias("gene_name"))


def read_gtf(spark: SparkSession, path: str, transcripts: bool = False) -> DataFrame:
    """Extent, strand, start of transcription and distinct exons (start, end) of each gene or transcript, from its exons."""
    exons = read_exons(spark, path, transcripts)
    out = exons.groupBy("gene_id", "gene_name", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("exons"))
    return out.withColumn("tss", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")))


def genes_in(genes: DataFrame, chrom: str, start: int, end: int, margin: int = 1) -> DataFrame:
    """Genes with an end in a window, their exons stitched where not further apart than ``margin``."""
    def grow(runs: Column, e: Column) -> Column:
        last = F.element_at(runs, -1)
        joined = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], e["end"]).alias("end"))))
        return F.when((F.size(runs) > 0) & (e["start"] <= F.try_element_at(runs, F.lit(-1))["end"] + margin), joined).otherwise(F.concat(runs, F.array(e)))

    exon = "array<struct<start:bigint,end:bigint>>"
    seen = genes.where((F.col("chrom") == chrom) & (F.col("start").between(start, end) | F.col("end").between(start, end)))
    return seen.withColumn("exons", F.aggregate("exons", F.array().cast(exon), lambda a, e: F.when(F.size(a) == 0, F.array(e)).otherwise(grow(a, e))))


def read_loops(spark: SparkSession, path: str, cut: int = 0) -> DataFrame:
    """Loops as they are written: loop_id, chrom (the key where chromosomes differ), anchors, distance; those nearer than ``cut`` go."""
    rows = _fields(spark, path).where((F.size("f") >= 8) & (_at(0) != "loopId"))
    key = F.when(_at(1) == _at(4), _at(1)).otherwise(F.concat_ws("-", _at(1), _at(4)))
    out = rows.select(_at(0).alias("loop_id"), key.alias("chrom"), *[_whole(i).alias(k) for i, k in ((2, "start_a"), (3, "end_a"), (5, "start_b"), (6, "end_b"), (7, "distance"))], (_at(1) == _at(4)).alias("cis"))
    return out.where("start_a IS NOT NULL AND end_a IS NOT NULL AND start_b IS NOT NULL AND end_b IS NOT NULL").where(F.col("distance") >= cut)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Domains as they are written: domain_id, chrom, start, end, length; whether they are significant is not known here."""
    rows = _fields(spark, path).where((F.size("f") >= 3) & (_at(0) != "domainId"))
    out = rows.select(_at(0).alias("domain_id"), _at(1).alias("chrom"), _whole(2).alias("start"), _whole(3).alias("end")).where("start IS NOT NULL AND end IS NOT NULL")
    return out.select("*", (F.col("end") - F.col("start")).alias("length"), F.lit(None).cast("boolean").alias("significant"))


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Edges a, type, b."""
    return _fields(spark, path).where(F.size("f") >= 3).select(_at(0).alias("a"), _at(1).alias("type"), _at(2).alias("b"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """anchor and genes: the first two columns."""
    return _fields(spark, path).where((F.size("f") >= 2) & (_at(0) != "Promoter")).select(_at(0).alias("anchor"), _at(1).alias("genes"))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(_at(0).alias("chrom"), _at(1, "long").alias("size")).where("size IS NOT NULL")


def unique_bedpe(rows: DataFrame) -> DataFrame:
    """One row for each pair of intervals."""
    return rows.dropDuplicates(["chrom_a", "start_a", "end_a", "chrom_b", "start_b", "end_b"])


def linker_bedpe(rows: DataFrame, near: int = 1_000) -> DataFrame:
    """Unique pairs; those nearer than ``near``, or of two chromosomes, only if the linker was found in a read.

    The name ends in the places of the linker in both reads, -1 for none.
    """
    far = F.abs(F.expr("(start_b + end_b) / 2 - (start_a + end_a) / 2"))
    told = F.split("name", "_")
    linker = (F.try_element_at(told, F.lit(-1)) != "-1") | (F.try_element_at(told, F.lit(-2)) != "-1")
    return unique_bedpe(rows.where(((F.col("chrom_a") == F.col("chrom_b")) & (far >= near)) | F.coalesce(linker, F.lit(False))))
