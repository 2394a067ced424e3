"""Paired tags, regions, genes, signals and reads derived from the star-schema tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.session import table


def pets_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired tags as they come: two ends with intervals, strands, mapping quality, library. Spread evenly."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('chr', l_suppkey % 4) AS chrom_a",
        "l_orderkey * 20 + l_linenumber AS pos_a",
        "concat('chr', l_partkey % 4) AS chrom_b",
        "l_partkey * 150 + l_suppkey AS pos_b",
        "CAST(l_quantity AS int) AS mapq",
        "if(l_returnflag = 'A', '+', '-') AS strand_a",
        "if(l_linestatus = 'F', '+', '-') AS strand_b",
        "l_linestatus AS library",
        "l_linenumber AS half",
    ).selectExpr("* EXCEPT (half)", "pos_a - half AS start_a", "pos_a + half AS end_a", "pos_b - half AS start_b", "pos_b + half AS end_b")


def pets_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cis tags with structure: half of them join hubs, some lie close together, some anywhere. Canonical, once each."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat('chr', l_suppkey % 2) AS chrom", "l_orderkey % 40 AS hub", "*").selectExpr(
        "chrom", "100000 + hub * 50000 + (l_partkey % 97) * 8 AS a",
        """CASE WHEN l_linenumber <= 3 THEN 250000 + hub * 50000 + (l_suppkey * 31 + l_orderkey) % 89 * 9
             WHEN l_linenumber <= 5 THEN 100030 + hub * 50000 + (l_partkey % 97) * 8 + (l_orderkey * 7) % 200
             ELSE (l_orderkey * 7919 + l_partkey * 104729) % 2400000 END AS b""", "l_linestatus AS library",
    )
    x, y = F.least("a", "b").cast("long"), F.greatest("a", "b").cast("long")
    key = F.concat_ws("-", "chrom", "chrom")
    return rows.select(key.alias("key"), F.col("chrom").alias("chrom_a"), F.col("chrom").alias("chrom_b"), x.alias("x"), y.alias("y"), (y - x).alias("dist"), "library").distinct()


def hub_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loops between hubs of the dense tags."""
    return table(spark, sf_dir, "part").where("p_partkey BETWEEN 1 AND 72").selectExpr("p_partkey AS loop_id", "concat('chr', p_partkey % 2) AS chrom", "p_partkey div 2 AS hub").selectExpr(
        "loop_id", "chrom", "100000 + hub * 50000 AS start_a", "100800 + hub * 50000 AS end_a", "250000 + hub * 50000 AS start_b", "250800 + hub * 50000 AS end_b"
    )


def hub_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over the close tags of the hubs."""
    return hub_loops(spark, sf_dir).selectExpr("loop_id AS region_id", "chrom", "start_a - 100 AS start", "end_a + 300 AS end")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named intervals, ends inclusive."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS region_id", "concat('chr', p_partkey % 4) AS chrom", "p_partkey * 150 AS start", "p_partkey * 150 + p_size * 40 AS end"
    )


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of regions: each with the one 40 places on, on the same chromosome."""
    r = regions(spark, sf_dir)
    b = r.selectExpr("region_id - 40 AS loop_id", "start AS start_b", "end AS end_b")
    return r.selectExpr("region_id AS loop_id", "chrom", "start AS start_a", "end AS end_a").join(b, "loop_id")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes with the start of transcription."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS gene_id", "concat('chr', s_suppkey % 4) AS chrom", "s_suppkey * 3000 AS tss", "s_suppkey * 3000 AS start", "s_suppkey * 3000 + 1500 + s_nationkey * 10 AS end"
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal in spans that do not overlap: chrom, start, end (exclusive), value around zero."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('chr', user_id % 4) AS chrom", "event_id * 30 AS start", "event_id * 30 + 30 AS end", "round(value - 50, 6) AS value", "event_type"
    )


def bins_of_signal(spark: SparkSession, sf_dir: str, size: int, where: str = "true") -> DataFrame:
    """Mean value of spans by bin of their start: chrom, start, end, value."""
    rows = signal(spark, sf_dir).where(where).groupBy("chrom", (F.floor(F.col("start") / size) * size).alias("start")).agg(F.round(F.avg("value"), 6).alias("value"))
    return rows.select("chrom", "start", (F.col("start") + size).alias("end"), "value")


def read_pairs(spark: SparkSession, sf_dir: str, linker: str) -> DataFrame:
    """Reads made of digests, with the linker in some of them: name, seq_a, qual_a, seq_b, qual_b."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "md5(concat('a', o_orderkey)) AS a", "md5(concat('b', o_orderkey)) AS b")
    dna = "translate({}, '0123456789abcdef', 'ACGTACGTACGTACGT')"
    rows = rows.selectExpr(
        "lpad(cast(k AS string), 12, '0') AS name", f"if(k % 3 = 0, concat(left({dna.format('a')}, k % 30), '{linker}', {dna.format('b')}), {dna.format('a')}) AS seq_a",
        f"if(k % 5 = 0, concat(left({dna.format('b')}, k % 25), '{linker}', {dna.format('a')}), {dna.format('b')}) AS seq_b",
    )
    return rows.selectExpr("name", "seq_a", "repeat('F', length(seq_a)) AS qual_a", "seq_b", "repeat('F', length(seq_b)) AS qual_b")
