"""What the named queries share: tables in SQL, the registry, the usual frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators import pets
from contactloom.sources import tables

MAPQ = 10
RAW = """WITH RECURSIVE raw AS (SELECT 'chr' || (l_suppkey % 4) AS ca, l_orderkey * 20 + l_linenumber AS pa, 'chr' || (l_partkey % 4) AS cb, l_partkey * 150 + l_suppkey AS pb,
 l_quantity::INT AS mapq, CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END AS sa, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS sb, l_linestatus AS library, l_linenumber AS half FROM lineitem),
sw AS (SELECT *, CASE WHEN ca = cb THEN pa > pb ELSE ca > cb END AS swap FROM raw),
can AS (SELECT CASE WHEN swap THEN cb ELSE ca END AS chrom_a, CASE WHEN swap THEN ca ELSE cb END AS chrom_b, CASE WHEN swap THEN pb ELSE pa END AS x, CASE WHEN swap THEN pa ELSE pb END AS y,
 CASE WHEN swap THEN sb ELSE sa END AS strand_a, CASE WHEN swap THEN sa ELSE sb END AS strand_b, mapq, library, half, swap FROM sw),
c2 AS (SELECT *, chrom_a || '-' || chrom_b AS key, CASE WHEN chrom_a = chrom_b THEN y - x END AS dist FROM can),
pets AS (SELECT DISTINCT key, chrom_a, chrom_b, x, y, dist FROM c2 WHERE mapq >= 10),
cis AS (SELECT *, chrom_a AS chrom FROM pets WHERE dist IS NOT NULL),
regions AS (SELECT p_partkey AS region_id, 'chr' || (p_partkey % 4) AS chrom, p_partkey * 150 AS s, p_partkey * 150 + p_size * 40 AS e FROM part),
loops AS (SELECT a.region_id AS loop_id, a.chrom, a.s AS sa, a.e AS ea, b.s AS sb, b.e AS eb FROM regions a JOIN regions b ON b.region_id = a.region_id + 40),
genes AS (SELECT s_suppkey AS gene_id, 'chr' || (s_suppkey % 4) AS chrom, s_suppkey * 3000 AS tss, s_suppkey * 3000 AS gs, s_suppkey * 3000 + 1500 + s_nationkey * 10 AS ge FROM supplier),
signal AS (SELECT 'chr' || (user_id % 4) AS chrom, event_id * 30 AS s, event_id * 30 + 30 AS e, round(value - 50, 6) AS v, event_type FROM events),
den AS (SELECT DISTINCT chrom, least(a, b)::BIGINT AS x, greatest(a, b)::BIGINT AS y, library FROM (SELECT chrom, 100000 + hub * 50000 + (l_partkey % 97) * 8 AS a,
 CASE WHEN l_linenumber <= 3 THEN 250000 + hub * 50000 + (l_suppkey * 31 + l_orderkey) % 89 * 9 WHEN l_linenumber <= 5 THEN 100030 + hub * 50000 + (l_partkey % 97) * 8 + (l_orderkey * 7) % 200 ELSE (l_orderkey * 7919 + l_partkey * 104729) % 2400000 END AS b, l_linestatus AS library
 FROM (SELECT 'chr' || (l_suppkey % 2) AS chrom, l_orderkey % 40 AS hub, * FROM lineitem))),
hubs AS (SELECT p_partkey AS loop_id, 'chr' || (p_partkey % 2) AS chrom, 100000 + (p_partkey // 2) * 50000 AS sa, 100800 + (p_partkey // 2) * 50000 AS ea, 250000 + (p_partkey // 2) * 50000 AS sb, 250800 + (p_partkey // 2) * 50000 AS eb FROM part WHERE p_partkey BETWEEN 1 AND 72),
spots AS (SELECT loop_id AS region_id, chrom, sa - 100 AS s, ea + 300 AS e FROM hubs),
org AS (SELECT key, min(x) AS o FROM cis GROUP BY key)
"""


def cells(size: int, where: str = "") -> str:
    return f"(SELECT key, (x - o) // {size} AS bin_x, (y - o) // {size} AS bin_y, count(*) AS n FROM cis JOIN org USING (key) GROUP BY ALL {where})"


PLANS: dict[str, tuple[Callable, str | None]] = {}


def plan(sql: str | None = None):
    def add(of: Callable) -> Callable:
        PLANS[of.__name__] = (of, RAW + sql if sql else None)
        return of

    return add


def raw(spark: SparkSession, d: str) -> DataFrame:
    return pets.canonical(tables.pets_raw(spark, d))


def unique(spark: SparkSession, d: str) -> DataFrame:
    return pets.unique(pets.keep(raw(spark, d), MAPQ))


def library(spark: SparkSession, d: str, name: str) -> DataFrame:
    return pets.unique(pets.keep(raw(spark, d).where(F.col("library") == name), MAPQ))


def dense(spark: SparkSession, d: str, name: str | None = None) -> DataFrame:
    """The dense pairs of one library, or of all, once each."""
    rows = tables.pets_dense(spark, d)
    return rows.where(F.col("library") == name) if name else rows
