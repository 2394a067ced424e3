"""Results as rows of text formats, and writers of them.

Every ``..._lines`` function gives the columns of a format in order; ``write_text``
writes them as tab-separated text, in as many files as the rows have partitions.
Numbers of rows are given by ``numbered``, without one task that sees all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactloom.operators import intervals

#: Columns of the text formats.
PEAKS = ("peakId", "chr", "start", "end", "summit", "length", "counts", "RPKM", "enrichmentScore", "poissonPvalue", "controlCounts", "controlRPKM", "controlScaledCounts", "enrichmentScoreVsControl", "poissonPvalueVsControl", "pValueHarmonicMean", "significant")
QUANT_PEAKS = ("peakId", "chr", "start", "end", "length", "counts", "RPKM", "enrichmentScore", "poissonPvalue")
LOOPS = ("loopId", "chrA", "startA", "endA", "chrB", "startB", "endB", "distance(bp)", "centerA", "centerB", "readsA", "readsB", "cis", "PETs", "density", "enrichmentScore", "P2LL", "FDR", "binomialPvalue", "hypergeometricPvalue", "poissonPvalue", "poissonPvaluePeakA", "poissonPvaluePeakB", "significant")
DIFF_LOOPS = ("loopId", "chrA", "startA", "endA", "chrB", "startB", "endB", "distance(bp)", "centerA", "centerB", "rawTargetAnchorAReads", "rawTargetAnchorBReads", "rawControlAnchorAReads", "rawControlAnchorBReads", "scaledTargetAnchorAReads", "scaledTargetAnchorBReads", "rawTargetCounts", "scaledTargetCounts", "rawControlCounts", "rawTargetNearbyMedianCounts", "scaledTargetNearbyMedianCounts", "rawControlNearbyMedianCounts", "rawTargetES", "rawControlES", "targetDensity", "controlDensity", "rawFc", "scaledFc", "poissonPvalue", "significant")
DOMAINS = ("domainId", "chr", "start", "end", "length", "binSize", "winSize", "segregationScore", "totalPETs", "withinDomainPETs", "enrichmentScore", "density", "significant")


def numbered(rows: DataFrame, *order: str, name: str = "i") -> DataFrame:
    """``rows`` with their place from 0 in the given order: a range sort, and what every partition holds ahead of the next."""
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_ahead"))
    return placed.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + row).drop("_id", "_part", "_ahead")


def write_text(rows: DataFrame, path: str, header: bool = False, compress: bool = False) -> None:
    """All columns as tab-separated lines; null is ``.``."""
    shown = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(".")).alias(c) for c in rows.columns])
    shown.write.csv(path, sep="\t", mode="overwrite", header=header, emptyValue="", quote="", compression="gzip" if compress else "none")


def _kept(rows: DataFrame, significant: bool) -> DataFrame:
    return rows.where(F.col("significant").cast("int") == 1) if significant else rows


def _listed(values: Column) -> Column:
    """An array as text."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ", "), F.lit("]"))


def _sides(key: Column) -> tuple[Column, Column]:
    """Both chromosomes of a loop's chrom, which is one, or two joined by the middle dash of a key."""
    return F.coalesce(F.nullif(F.regexp_extract(key, r"^(.+)-(.+)$", 1), F.lit("")), key), F.coalesce(F.nullif(F.regexp_extract(key, r"^(.+)-(.+)$", 2), F.lit("")), key)


# pairs


def _span(at: str, ext: int) -> list[Column]:
    return [F.greatest(F.lit(0), F.col(at) - ext), F.col(at) + ext]


def bed_lines(pets: DataFrame, ext: int = 50) -> DataFrame:
    """Distinct positions of cis pairs, ``ext`` to both sides, cut at zero: chrom, start, end."""
    pos = intervals.ends(intervals.points(pets)).select("chrom", "pos").distinct()
    start, end = _span("pos", ext)
    return pos.select("chrom", start.alias("start"), end.alias("end"))


def bedpe_lines(pets: DataFrame, ext: int = 50) -> DataFrame:
    """Cis pairs as ten columns, numbered in order, strands + and -."""
    a, b = _span("x", ext), _span("y", ext)
    rows = numbered(intervals.points(pets), "chrom", "x", "y", name="name")
    return rows.select(
        F.col("chrom").alias("chrom_a"), a[0].alias("start_a"), a[1].alias("end_a"), F.col("chrom").alias("chrom_b"), b[0].alias("start_b"), b[1].alias("end_b"),
        "name", F.lit(".").alias("score"), F.lit("+").alias("strand_a"), F.lit("-").alias("strand_b"),
    )


def mirrored(pets: DataFrame) -> DataFrame:
    """Cis pairs from both sides: chrom, x, y."""
    p = intervals.points(pets)
    return p.unionByName(p.select("chrom", F.col("y").alias("x"), F.col("x").alias("y")))


def link_lines(pets: DataFrame, ext: int = 50) -> DataFrame:
    """Long-range text: every cis pair from both sides with its partner and score 1, numbered by place."""
    a, b = _span("x", ext), _span("y", ext)
    rows = numbered(mirrored(pets), "chrom", "x", "y", name="id")
    partner = F.format_string("%s:%d-%d,1", F.col("chrom"), *b)
    return rows.select("chrom", a[0].alias("start"), a[1].alias("end"), partner.alias("partner"), "id", F.lit(".").alias("strand"))


def interact_lines(pets: DataFrame, ext: int = 50) -> DataFrame:
    """The eighteen columns of an interact track: every cis pair from both sides."""
    a, b = _span("x", ext), _span("y", ext)
    dot, one = F.lit("."), F.lit(1)
    columns = [F.col("chrom"), *a, dot, one, one, dot, F.lit(0), F.col("chrom"), *a, dot, dot, F.col("chrom"), *b, dot, dot]
    names = ["chrom", "start", "end", "name", "score", "value", "exp", "color", "source_chrom", "source_start", "source_end", "source_name", "source_strand", "target_chrom", "target_start", "target_end", "target_name", "target_strand"]
    return mirrored(pets).select(*[c.alias(n) for c, n in zip(columns, names, strict=True)])


def short_lines(pets: DataFrame) -> DataFrame:
    """Short text with strands for matrix tools: all pairs, cis and trans."""
    columns = [F.lit(0), F.col("chrom_a"), F.col("x"), F.lit(0), F.lit(1), F.col("chrom_b"), F.col("y"), F.lit(1)]
    return pets.select(*[c.alias(n) for c, n in zip(columns, ("str_a", "chrom_a", "pos_a", "frag_a", "str_b", "chrom_b", "pos_b", "frag_b"), strict=True)])


def bedgraph_lines(pets: DataFrame, total: int, ext: int = 50, pairs: bool = False) -> DataFrame:
    """Depth in runs, per million tags, to three places: chrom, start, end, value."""
    return intervals.coverage(pets, ext, pairs).select("chrom", "start", "end", F.round(F.col("depth") / (2 * total) * 1e6, 3).alias("value"))


# calls


def _column(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None)


def peak_lines(peaks: DataFrame) -> DataFrame:
    told = ("peak_id", "chrom", "start", "end", "summit", "length", "counts", "density", "escores", "pvalues", "control_counts", "control_density", "control_scaled", "es_control", "p_control", "p_mean", "significant")
    columns = [_listed(F.col(c)) if c in ("escores", "pvalues") else _column(peaks, c) for c in told]
    return peaks.select(*[c.alias(n) for c, n in zip(columns, PEAKS, strict=True)])


def peak_bed_lines(peaks: DataFrame, significant: bool = True) -> DataFrame:
    info = [F.format_string("%s;%dbp;%d reads;summit:%d;p-value:%s", "peak_id", "length", "counts", "summit", _listed(F.col("pvalues")))]
    if "control_counts" in peaks.columns:
        info.append(F.format_string(";control_counts:%d;enrichment_score_vs_control:%s;control_scaled_counts:%s;p-value_vs_control:%s", "control_counts", *[F.col(c).cast("string") for c in ("es_control", "control_scaled", "p_control")]))
    return _kept(peaks, significant).select("chrom", "start", "end", F.concat(*info).alias("info"), F.get("escores", F.lit(0)).alias("score"))


def quant_peak_lines(peaks: DataFrame) -> DataFrame:
    told = ("peak_id", "chrom", "start", "end", "length", "counts", "density", "escores", "pvalues")
    return peaks.select(*[(_listed(F.col(c)) if c in ("escores", "pvalues") else F.col(c)).alias(n) for c, n in zip(told, QUANT_PEAKS, strict=True)])


def _loop_columns(loops: DataFrame) -> list[Column]:
    a, b = _sides(F.col("chrom"))
    mid = [(F.col(f"start_{s}") + F.col(f"end_{s}")) / 2 for s in "ab"]
    cis = a == b
    return [F.col("loop_id"), a, F.col("start_a"), F.col("end_a"), b, F.col("start_b"), F.col("end_b"), F.when(cis, F.abs(mid[1] - mid[0])).otherwise(-1.0), *mid]


def loop_lines(loops: DataFrame, quantified: bool = False) -> DataFrame:
    """Twenty-four columns; twenty-three, without significant, of quantified loops."""
    a, b = _sides(F.col("chrom"))
    told = ["density", "es", "p2ll", "fdr", "binomial_p", "hypergeometric_p", "poisson_p", "p_a", "p_b"]
    columns = [*_loop_columns(loops), F.col("ra"), F.col("rb"), a == b, F.col("rab"), *[F.col(c) for c in told], *([] if quantified else [F.col("significant")])]
    return loops.select(*[c.alias(n) for c, n in zip(columns, LOOPS, strict=quantified is False)])


def loop_interact_lines(loops: DataFrame, significant: bool = True) -> DataFrame:
    a, b = _sides(F.col("chrom"))
    dot = F.lit(".")
    columns = [a, F.col("start_a"), F.col("end_b"), F.col("loop_id"), F.col("rab").cast("int"), F.col("density"), dot, F.lit("#0000FF"), a, F.col("start_a"), F.col("end_a"), dot, dot, b, F.col("start_b"), F.col("end_b"), dot, dot]
    names = ["#chrom", "chromStart", "chromEnd", "name", "score", "value", "exp", "color", "sourceChrom", "sourceStart", "sourceEnd", "sourceName", "sourceStrand", "targetChrom", "targetStart", "targetEnd", "targetName", "targetStrand"]
    return _kept(loops, significant).select(*[c.alias(n) for c, n in zip(columns, names, strict=True)])


def _box_columns(loops: DataFrame) -> dict[str, Column]:
    a, b = _sides(F.col("chrom"))
    return {"chromosome1": a, "x1": F.col("start_a"), "x2": F.col("end_a"), "chromosome2": b, "y1": F.col("start_b"), "y2": F.col("end_b"), "color": F.lit('"0,255,255"')}


def loop_box_lines(loops: DataFrame, significant: bool = True) -> DataFrame:
    """Boxes on a matrix with tests; p-values as -log10."""
    told = {"observed": "rab", "loopId": "loop_id", "FDR": "fdr", "EnrichmentScore": "es", "P2LL": "p2ll", "distance": None, "counts_X": "ra", "counts_Y": "rb", "density": "density"}
    tests = {"-log10(binomal_p-value)": "binomial_p", "-log10(poisson_p-value)": "poisson_p", "-log10(hypergeometric_p-value)": "hypergeometric_p", "-log10(poisson_p-value_peak_x)": "p_a", "-log10(poisson_p-value_peak_y)": "p_b"}
    columns = _box_columns(loops) | {k: F.col(v) if v else _loop_columns(loops)[7] for k, v in told.items()} | {k: -F.log10(v) for k, v in tests.items()}
    return _kept(loops, significant).select(*[c.alias(n) for n, c in columns.items()])


def loop_link_lines(loops: DataFrame, significant: bool = True) -> DataFrame:
    """Three columns: both anchors and 1."""
    a, b = _sides(F.col("chrom"))
    side = [F.format_string("%s:%d-%d", c, f"start_{s}", f"end_{s}").alias(f"anchor_{s}") for c, s in ((a, "a"), (b, "b"))]
    return _kept(loops, significant).select(*side, F.lit("1").alias("score"))


def loop_mirror_lines(loops: DataFrame, significant: bool = True, score: str | None = "rab") -> DataFrame:
    """Each loop from both sides with its partner and score (1, if none is named)."""
    a, b = _sides(F.col("chrom"))
    value = F.col(score).cast("string") if score else F.lit("1")
    ends = []
    for c, s, d, t in ((a, "a", b, "b"), (b, "b", a, "a")):
        partner = F.concat(F.format_string("%s:%d-%d,", d, f"start_{t}", f"end_{t}"), value)
        ends.append(F.struct(c.alias("chrom"), F.col(f"start_{s}").alias("start"), F.col(f"end_{s}").alias("end"), partner.alias("partner")))
    return _kept(loops, significant).select(F.explode(F.array(*ends)).alias("e")).select("e.*")


_DIFF = ("ra_t", "rb_t", "ra_c", "rb_c", "scaled_ra", "scaled_rb", "rab_t", "scaled_rab", "rab_c", "around_t", "scaled_around", "around_c", "es_t", "es_c", "density_t", "density_c", "raw_fc", "scaled_fc", "p", "significant")


def diff_loop_lines(loops: DataFrame) -> DataFrame:
    return loops.select(*[c.alias(n) for c, n in zip([*_loop_columns(loops), *map(F.col, _DIFF)], DIFF_LOOPS, strict=True)])


def diff_box_lines(loops: DataFrame, significant: bool = True) -> DataFrame:
    names = ("rawTargetCounts", "scaledTargetCounts", "rawControlCounts", "rawTargetNearbyMeanCounts", "scaledTargetNearbyMeanCounts", "rawControlNearbyMeanCounts", "rawTargetES", "rawControlES", "targetDensity", "controlDensity", "rawFc", "scaledFc", "poissonPvalue")
    columns = _box_columns(loops) | {"loopId": F.col("loop_id"), "distance": _loop_columns(loops)[7]} | dict(zip(names, map(F.col, _DIFF[6:-1]), strict=True))
    return _kept(loops, significant).select(*[c.alias(n) for n, c in columns.items()])


def diff_mirror_lines(loops: DataFrame, significant: bool = True) -> DataFrame:
    return loop_mirror_lines(loops, significant, None)


def domain_lines(domains: DataFrame) -> DataFrame:
    told = ("domain_id", "chrom", "start", "end", "length", "bin_size", "win_size", "ss", "total_pets", "within_pets", "es", "density", "significant")
    return domains.select(*[_column(domains, c).alias(n) for c, n in zip(told, DOMAINS, strict=True)])


def domain_bed_lines(domains: DataFrame) -> DataFrame:
    info = F.format_string("%s;%dbp;ES:%.3f;SS:%.3f;binSize:%d;winSize:%d", "domain_id", "length", "es", "ss", "bin_size", "win_size")
    return _kept(domains, True).select("chrom", "start", "end", info.alias("info"))


def score_lines(scores: DataFrame, value: str = "ss") -> DataFrame:
    """Scores by place as bedGraph."""
    chrom = F.expr("substring(key, 1, (length(key) - 1) div 2)")
    start = "start" if "start" in scores.columns else "pos"
    return scores.select(chrom.alias("chrom"), F.col(start).alias("start"), "end", F.col(value).alias("value"))


def network_lines(edges: DataFrame) -> DataFrame:
    return edges.select("a", "type", "b")


def target_lines(targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """Promoters with their genes and, joined by commas, what they reach."""
    names = {"directEnhancer": "direct_enhancers", "indirectEnhancer": "indirect_enhancers", "directPromoter": "direct_promoters", "indirectPromoter": "indirect_promoters"}
    rows = targets.join(anchors.select(F.col("anchor").alias("promoter"), "genes"), "promoter")
    return rows.select(
        F.col("promoter").alias("Promoter"), F.array_join("genes", ",").alias("PromoterTarget"), *[F.array_join(c, ",").alias(n) for n, c in names.items()],
        F.col("direct_hub").alias("directEnhancerHub"), F.col("indirect_hub").alias("indirectEnhancerHub"),
    )
