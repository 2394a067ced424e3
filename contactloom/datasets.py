"""A library of unique pairs as a folder: pairs by key in Parquet, and counts of how they came about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators import pets

COLUMNS = ("key", "chrom_a", "chrom_b", "x", "y", "dist")


def write(rows: DataFrame, path: str, counts: DataFrame | None = None) -> None:
    """Canonical pairs (key, x, y and what follows from them), and one row of counts."""
    rows.select(*COLUMNS).write.partitionBy("key").mode("errorifexists").parquet(f"{path}/pairs")
    refresh(rows.sparkSession, path, counts)


def refresh(spark: SparkSession, path: str, counts: DataFrame | None = None) -> None:
    """Count again what is in the folder: keys with their pairs and extent, and the counts given, or the unique pairs alone."""
    catalog = pets.catalog(pairs(spark, path))
    catalog.write.mode("overwrite").json(f"{path}/catalog")
    told = counts if counts is not None else catalog.agg(F.coalesce(F.sum("pets"), F.lit(0)).alias("unique_pets"))
    told.write.mode("overwrite").json(f"{path}/counts")


def pairs(spark: SparkSession, path: str, cut: int = 0, mcut: int = -1, chroms: tuple[str, ...] = ()) -> DataFrame:
    """The pairs, cis ones within the distances; keys are pruned by folder."""
    rows = spark.read.parquet(f"{path}/pairs").select(*COLUMNS).withColumn("mapq", F.lit(255))
    return pets.keep(rows, chroms=chroms, cut=cut, mcut=mcut).drop("mapq")


def total(spark: SparkSession, path: str) -> int:
    """Unique pairs, as counted when the folder was written."""
    return int(spark.read.json(f"{path}/counts").agg(F.sum("unique_pets")).first()[0] or 0)


def of_points(points: DataFrame) -> DataFrame:
    """Cis points (chrom, x, y) as pairs."""
    key = F.concat_ws("-", "chrom", "chrom")
    return points.select(key.alias("key"), F.col("chrom").alias("chrom_a"), F.col("chrom").alias("chrom_b"), "x", "y", (F.col("y") - F.col("x")).alias("dist"))


def of_keys(rows: DataFrame) -> DataFrame:
    """Rows (key, x, y) as pairs; the key is parted at its middle where both halves are equal, at its first dash otherwise."""
    same = F.expr("substring(key, 1, (length(key) - 1) div 2) = right(key, (length(key) - 1) div 2) AND length(key) % 2 = 1")
    a = F.when(same, F.expr("left(key, (length(key) - 1) div 2)")).otherwise(F.substring_index("key", "-", 1))
    b = F.when(same, F.expr("right(key, (length(key) - 1) div 2)")).otherwise(F.expr("substring(key, instr(key, '-') + 1)"))
    return rows.withColumns({"chrom_a": a, "chrom_b": b}).select("key", "chrom_a", "chrom_b", "x", "y", F.when(F.col("chrom_a") == F.col("chrom_b"), F.col("y") - F.col("x")).alias("dist"))
