"""Named queries over the star-schema tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions import tails
from contactloom.operators import domains, estimates, intervals, matrix, network, pets, profiles, quantify
from contactloom.plans.common import PLANS, cells, library, plan, raw, unique
from contactloom.session import prepare
from contactloom.sources import tables, tracks

_RATIO = "round({} / greatest({}, 1)::DOUBLE, 6)"


@plan(f"""SELECT library, sum(copies)::BIGINT AS total_pets, count(*) AS unique_pets, count(dist) AS cis, count(*) - count(dist) AS trans, coalesce(round(avg(dist), 6), 0.0) AS mean_distance,
 count(*) FILTER (dist <= 1000) AS close_pets, count(*) FILTER (dist > 1000 AND dist <= 10000) AS middle_pets, count(*) FILTER (dist > 10000) AS distal_pets,
 round(1 - count(*) / sum(copies)::DOUBLE, 6) AS redundancy, {_RATIO.format('count(dist)', 'count(*)')} AS cis_ratio, {_RATIO.format('(count(*) - count(dist))', 'count(*)')} AS trans_ratio,
 {_RATIO.format('count(*) FILTER (dist <= 1000)', 'count(dist)')} AS close_ratio, {_RATIO.format('count(*) FILTER (dist > 1000 AND dist <= 10000)', 'count(dist)')} AS middle_ratio, {_RATIO.format('count(*) FILTER (dist > 10000)', 'count(dist)')} AS distal_ratio
,
 count(dist) FILTER (strand_a <> strand_b) AS opposite_pets, count(dist) FILTER (strand_a = '+' AND strand_b = '+') AS forward_pets, count(dist) FILTER (strand_a = '-' AND strand_b = '-') AS reverse_pets
 FROM (SELECT library, chrom_a, chrom_b, x - half AS s1, x + half AS e1, y - half AS s2, y + half AS e2, strand_a, strand_b, any_value(dist) AS dist, count(*) AS copies FROM c2 GROUP BY ALL) GROUP BY library""")
def qc_summary(spark, d):
    return pets.quality(tables.pets_raw(spark, d))


@plan("SELECT key, x, y, dist FROM pets")
def pre_dedup(spark, d):
    return unique(spark, d).select("key", "x", "y", "dist")


@plan("SELECT key, count(*) AS pets, min(x) AS min_x, max(y) AS max_y FROM pets GROUP BY key")
def pre_meta(spark, d):
    return unique(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("pets"), F.min("x").alias("min_x"), F.max("y").alias("max_y"))


@plan("SELECT key, x, y, dist FROM pets WHERE dist BETWEEN 1000 AND 100000")
def filter_distance(spark, d):
    return pets.keep(unique(spark, d).withColumn("mapq", F.lit(255)), cut=1000, mcut=100_000, cis_only=True).select("key", "x", "y", "dist")


@plan("SELECT DISTINCT key, x, y FROM c2 WHERE mapq >= 10")
def combine_keep1(spark, d):
    return pets.combine([library(spark, d, "F"), library(spark, d, "O")], 1)


@plan("SELECT key, x, y FROM (SELECT key, x, y, row_number() OVER (PARTITION BY key, x, y) AS i FROM (SELECT key, x, y FROM c2 UNION ALL SELECT key, x, y FROM c2 WHERE mapq >= 25 UNION ALL SELECT key, x, y FROM c2 WHERE mapq >= 40)) WHERE i <= 2")
def combine_keep2(spark, d):
    rows = raw(spark, d)
    return pets.combine([rows, rows.where("mapq >= 25"), rows.where("mapq >= 40")], 2)


@plan("SELECT key, x, y FROM pets WHERE ('0x' || substr(md5(key || ':' || x || ':' || y), 1, 8))::UBIGINT < 0.25 * 4294967296.0")
def sampleunique(spark, d):
    return pets.sample(unique(spark, d), 0.25).select("key", "x", "y")


@plan("SELECT chrom_a, x, y FROM cis WHERE EXISTS (SELECT 1 FROM regions r WHERE r.chrom = cis.chrom AND (x BETWEEN s AND e OR y BETWEEN s AND e))")
def filter_semi_regions(spark, d):
    return intervals.touching(unique(spark, d), tables.regions(spark, d)).select("chrom_a", "x", "y")


@plan("SELECT chrom_a, x, y FROM cis WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.chrom = cis.chrom AND (x BETWEEN s AND e OR y BETWEEN s AND e))")
def filter_anti_regions(spark, d):
    return intervals.touching(unique(spark, d), tables.regions(spark, d), inverse=True).select("chrom_a", "x", "y")


@plan("SELECT DISTINCT cis.chrom, x, y FROM cis JOIN loops l ON l.chrom = cis.chrom AND x BETWEEN sa AND ea AND y BETWEEN sb AND eb")
def filter_both_anchors(spark, d):
    return intervals.joining(unique(spark, d), tables.loops(spark, d))


@plan("SELECT key, x, y FROM (SELECT key, x, y, count(*) OVER (PARTITION BY key, (x - o) // 2000, (y - o) // 2000) AS n FROM cis JOIN org USING (key)) WHERE n > 1")
def filter_singletons(spark, d):
    return matrix.without_singletons(unique(spark, d), 2000)


_STITCH = ", m AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM regions), k AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m) "


@plan(_STITCH + 'SELECT chrom, min(s) AS start, max(e) AS "end", count(*) AS n FROM k GROUP BY chrom, run')
def stitch_regions(spark, d):
    return intervals.stitch(tables.regions(spark, d))


@plan("SELECT a.chrom, a.region_id AS id_a, b.region_id AS id_b FROM regions a JOIN regions b ON a.chrom = b.chrom AND a.region_id < b.region_id AND a.s <= b.e AND b.s <= a.e")
def overlap_1d(spark, d):
    r = tables.regions(spark, d)
    return intervals.overlaps(r, r)


@plan("SELECT a.chrom, a.loop_id AS id_a, b.loop_id AS id_b FROM loops a JOIN loops b ON a.chrom = b.chrom AND a.loop_id < b.loop_id AND a.sa <= b.ea AND b.sa <= a.ea AND a.sb <= b.eb AND b.sb <= a.eb")
def overlap_2d(spark, d):
    l = tables.loops(spark, d)
    first = l.selectExpr("loop_id AS region_id", "chrom", "start_a AS start", "end_a AS end")
    met = intervals.overlaps(first, first)
    far = l.select("loop_id", "start_b", "end_b")
    met = met.join(far.toDF("id_a", "sa", "ea"), "id_a").join(far.toDF("id_b", "sb", "eb"), "id_b")
    return met.where("sa <= eb AND sb <= ea").select("chrom", "id_a", "id_b")


@plan("SELECT region_id, gene_id, distance, CASE WHEN distance <= 2000 THEN 'Promoter' ELSE 'Enhancer' END AS kind FROM (SELECT region_id, gene_id, abs(tss - (s + e) // 2) AS distance, row_number() OVER (PARTITION BY region_id ORDER BY abs(tss - (s + e) // 2), gene_id) AS i FROM regions r JOIN genes g ON r.chrom = g.chrom) WHERE i = 1")
def nearest_tss(spark, d):
    return intervals.nearest_start(tables.regions(spark, d), tables.genes(spark, d))


@plan(f"SELECT * FROM {cells(5000)}")
def bins_2d(spark, d):
    return matrix.bins(unique(spark, d), 5000)


@plan(f", c AS {cells(5000)} SELECT key, bin_x, bin_y, sum(n)::BIGINT AS n FROM (SELECT * FROM c UNION ALL SELECT key, bin_y, bin_x, n FROM c) GROUP BY ALL")
def bins_symmetric(spark, d):
    return matrix.symmetric(matrix.bins(unique(spark, d), 5000))


def _res(size: int) -> str:
    return f"SELECT {size}::BIGINT AS bin_size, count(*) AS cells, sum(n)::BIGINT AS pets, count(*) FILTER (n = 1) AS singletons, round(count(*) FILTER (n = 1) / count(*), 6) AS cell_share, round(count(*) FILTER (n = 1) / sum(n), 6) AS pet_share FROM {cells(size)} WHERE bin_x <> bin_y"


@plan(" UNION ALL ".join(map(_res, (10000, 5000, 1000))))
def est_res(spark, d):
    return matrix.resolution(unique(spark, d), (10000, 5000, 1000))


@plan("SELECT (dist // 1000) * 1000 AS distance, count(*) AS observed FROM cis GROUP BY 1")
def obs_dist_freq(spark, d):
    return estimates.distances(unique(spark, d), 1000)


@plan("SELECT round(regr_slope(log10(n), log10(distance)), 6) AS slope, round(regr_intercept(log10(n), log10(distance)), 6) AS intercept, count(*) AS steps FROM (SELECT (dist // 1000) * 1000 AS distance, count(*) AS n FROM cis GROUP BY 1) WHERE distance > 0 AND distance < 10000000")
def dist_decay(spark, d):
    return estimates.decay(unique(spark, d), 1000)


@plan(f", c AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS total, sum(n) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS mass, sum(n) OVER () AS pets FROM {cells(5000)}) SELECT slice::INT AS slice, round(mass / pets, 6) AS share FROM range(1, 101) t(slice) JOIN c ON i = slice * total // 100")
def fingerprint(spark, d):
    return matrix.fingerprint(unique(spark, d), 5000)


_LIBS = ", ".join(f"count(*) FILTER (library = '{n}') AS n{n}" for n in "FO")


@plan(f""", l AS (SELECT DISTINCT key, x, y, library FROM c2 WHERE mapq >= 10 AND dist IS NOT NULL), u AS (SELECT key, min(x) AS o FROM l GROUP BY key),
 v AS (SELECT key, (x - o) // 10000 AS bx, (y - o) // 10000 AS by_, {_LIBS} FROM l JOIN u USING (key) GROUP BY ALL)
 SELECT 'F' AS sample_a, 'O' AS sample_b, round(corr(nF, nO), 6) AS pcc, count(*) AS cells FROM v WHERE greatest(nF, nO) > 2""")
def est_sim_pcc(spark, d):
    return matrix.similarity({n: library(spark, d, n) for n in "FO"}, 10_000)


_ENDS = "(SELECT chrom, x AS pos FROM cis UNION ALL SELECT chrom, y FROM cis)"


@plan(f", s AS (SELECT chrom, pos, sum(step) AS step FROM (SELECT chrom, greatest(0, pos - 50) AS pos, 1 AS step FROM {_ENDS} UNION ALL SELECT chrom, pos + 50, -1 FROM {_ENDS}) GROUP BY ALL HAVING sum(step) <> 0), r AS (SELECT chrom, pos AS start, lead(pos) OVER w AS e, sum(step) OVER w AS depth FROM s WINDOW w AS (PARTITION BY chrom ORDER BY pos)) SELECT chrom, start, e AS \"end\", depth::BIGINT AS depth FROM r WHERE depth > 0")
def coverage_bdg(spark, d):
    return intervals.coverage(unique(spark, d))


_COUNTS = "SELECT r.region_id, r.chrom, r.s AS start, r.e AS \"end\", count(x) AS any_end, count(*) FILTER (x BETWEEN s AND e AND y BETWEEN s AND e) AS both_ends FROM regions r LEFT JOIN cis ON r.chrom = cis.chrom AND (x BETWEEN s AND e OR y BETWEEN s AND e) GROUP BY ALL"


@plan(f"SELECT *, any_end - both_ends AS distal FROM ({_COUNTS})")
def peak_counts(spark, d):
    return intervals.region_counts(unique(spark, d), tables.regions(spark, d))


@plan(f"SELECT region_id, both_ends AS inside, any_end - both_ends AS outside, CASE WHEN any_end = both_ends THEN 100.0 ELSE round(both_ends / (any_end - both_ends), 6) END AS es, round(both_ends * 1e9 / (SELECT count(*) FROM pets) / greatest(\"end\" - start, 1), 6) AS density FROM ({_COUNTS})")
def domain_quant(spark, d):
    p = unique(spark, d)
    r = tables.regions(spark, d).selectExpr("region_id", "chrom", "start", "end", "end - start AS length")
    t = domains.tested(p, r, p.count())
    return t.select("region_id", F.col("within_pets").alias("inside"), (F.col("total_pets") - F.col("within_pets")).alias("outside"), F.round("es", 6).alias("es"), F.round("density", 6).alias("density"))


_LOOPS = "SELECT l.loop_id, l.chrom, sa AS start_a, ea AS end_a, sb AS start_b, eb AS end_b, count(x) AS pets FROM loops l LEFT JOIN cis ON l.chrom = cis.chrom AND x BETWEEN sa AND ea AND y BETWEEN sb AND eb GROUP BY ALL"


@plan(_LOOPS)
def loop_counts(spark, d):
    return intervals.loop_counts(unique(spark, d), tables.loops(spark, d))


@plan(f"SELECT round(sd_c / sd_t, 6) AS beta, round(mc - sd_c / sd_t * mt, 6) AS alpha FROM (SELECT stddev_pop(log2(both_ends + 1)) AS sd_c, stddev_pop(log2(any_end + 1)) AS sd_t, avg(log2(both_ends + 1)) AS mc, avg(log2(any_end + 1)) AS mt FROM ({_COUNTS}))")
def manorm(spark, d):
    return tails.ma_norm(intervals.region_counts(unique(spark, d), tables.regions(spark, d)), "any_end", "both_ends")


_PLACES = ", span AS (SELECT key, min(x) + 20000 AS s, max(y) - 20000 AS e FROM cis GROUP BY key), w AS (SELECT key, s + i * 5000 AS pos FROM span, generate_series(0, (e - s) // 5000 - 1) t(i) WHERE e - s >= 5000)"


@plan(_PLACES + """, c AS (SELECT w.key, pos, count(*) FILTER (x >= pos - 20000 AND y <= pos + 20000) AS a, count(*) FILTER (x >= pos - 20000 AND y <= pos) AS l, count(*) FILTER (x >= pos AND y <= pos + 20000) AS r
 FROM w JOIN cis ON cis.key = w.key AND x >= pos - 20000 AND y <= pos + 20000 GROUP BY ALL), s AS (SELECT key, pos, (a - l - r) / (l + r) AS score FROM c WHERE l + r > 0)
 SELECT key, pos, pos + 5000 AS "end", round(score, 6) AS score, round((score - avg(score) OVER k) / nullif(stddev_pop(score) OVER k, 0), 4) AS z FROM s WINDOW k AS (PARTITION BY key)""")
def insulation(spark, d):
    return matrix.insulation(unique(spark, d), 5_000, 20_000)


@plan(_PLACES + """, c AS (SELECT w.key, pos, count(*) FILTER (y <= pos) AS a, count(*) FILTER (x >= pos) AS b FROM w JOIN cis ON cis.key = w.key AND x >= pos - 20000 AND y <= pos + 20000 GROUP BY ALL)
 SELECT key, pos, pos + 5000 AS "end", a, b, round(sign(b - a) * ((a - (a + b) / 2) ** 2 + (b - (a + b) / 2) ** 2) / ((a + b) / 2), 6) AS di FROM c WHERE a + b > 0""")
def directionality(spark, d):
    return matrix.directionality(unique(spark, d), 5_000, 20_000)


@plan(""", span AS (SELECT key, min(x) + 5000 AS s, max(y) - 5000 AS e, count(*) AS total FROM cis GROUP BY key), w AS (SELECT key, total, s + i * 1000 AS p FROM span, generate_series(0, (e - s) // 1000 - 1) t(i) WHERE e - s >= 1000),
 c AS (SELECT w.key, p, count(*) AS n FROM w JOIN generate_series(-5, 5) g(j) ON j <> 0 JOIN cis ON cis.key = w.key AND (x BETWEEN p AND p + 1000 OR y BETWEEN p AND p + 1000) AND (x BETWEEN p + j * 1000 AND p + j * 1000 + 1000 OR y BETWEEN p + j * 1000 AND p + j * 1000 + 1000) GROUP BY ALL)
 SELECT key, p AS start, p + 1000 AS "end", round(coalesce(n, 0) * 1e6 / total, 6) AS ids FROM w LEFT JOIN c USING (key, p)""")
def local_density(spark, d):
    return matrix.local_density(unique(spark, d), 1_000, 10)


@plan('SELECT DISTINCT chrom, greatest(0, pos - 50) AS start, pos + 50 AS "end" FROM (SELECT DISTINCT chrom, x AS pos FROM cis UNION SELECT chrom, y FROM cis)')
def dump_bed(spark, d):
    return tracks.bed_lines(unique(spark, d))


@plan("SELECT chrom AS chrom_a, greatest(0, x - 50) AS start_a, x + 50 AS end_a, chrom AS chrom_b, greatest(0, y - 50) AS start_b, y + 50 AS end_b, row_number() OVER (ORDER BY chrom, x, y) - 1 AS name, '.' AS score, '+' AS strand_a, '-' AS strand_b FROM cis")
def dump_bedpe(spark, d):
    return tracks.bedpe_lines(unique(spark, d))


_MIRROR = "(SELECT chrom, x, y FROM cis UNION ALL SELECT chrom, y, x FROM cis)"


@plan(f"SELECT chrom, greatest(0, x - 50) AS start, x + 50 AS \"end\", chrom || ':' || greatest(0, y - 50) || '-' || (y + 50) || ',1' AS partner, row_number() OVER (ORDER BY chrom, x, y) - 1 AS id, '.' AS strand FROM {_MIRROR}")
def dump_links(spark, d):
    return tracks.link_lines(unique(spark, d))


@plan(f"SELECT chrom, greatest(0, x - 50) AS start, x + 50 AS \"end\", '.' AS name, 1 AS score, 1 AS value, '.' AS exp, 0 AS color, chrom AS source_chrom, greatest(0, x - 50) AS source_start, x + 50 AS source_end, '.' AS source_name, '.' AS source_strand, chrom AS target_chrom, greatest(0, y - 50) AS target_start, y + 50 AS target_end, '.' AS target_name, '.' AS target_strand FROM {_MIRROR}")
def dump_interact(spark, d):
    return tracks.interact_lines(unique(spark, d))


@plan("SELECT 0 AS str_a, chrom_a, x AS pos_a, 0 AS frag_a, 1 AS str_b, chrom_b, y AS pos_b, 1 AS frag_b FROM pets")
def dump_short(spark, d):
    return tracks.short_lines(unique(spark, d))


def _depth(ends: str) -> str:
    return f", s AS (SELECT chrom, pos, sum(step) AS step FROM ({ends}) GROUP BY ALL HAVING sum(step) <> 0), r AS (SELECT chrom, pos AS start, lead(pos) OVER w AS e, sum(step) OVER w AS depth FROM s WINDOW w AS (PARTITION BY chrom ORDER BY pos))"


@plan(_depth("SELECT chrom, greatest(0, x - 50) AS pos, 1 AS step FROM cis UNION ALL SELECT chrom, y + 50, -1 FROM cis") + ' SELECT chrom, start, e AS "end", round(depth::BIGINT / (2 * (SELECT count(*) FROM pets)) * 1e6, 3) AS value FROM r WHERE depth > 0')
def dump_bedgraph_pairs(spark, d):
    p = unique(spark, d)
    return tracks.bedgraph_lines(p, p.count(), pairs=True)


@plan("SELECT bin_x, bin_y, sum(n)::BIGINT AS n FROM (SELECT (x - 2000) // 500 AS bin_x, (y - 2000) // 500 AS bin_y, count(*) AS n FROM cis WHERE key = 'chr1-chr1' AND x >= 2000 AND y <= 18000 GROUP BY ALL UNION ALL SELECT (y - 2000) // 500, (x - 2000) // 500, count(*) FROM cis WHERE key = 'chr1-chr1' AND x >= 2000 AND y <= 18000 GROUP BY ALL) GROUP BY ALL")
def dump_matrix(spark, d):
    return matrix.window_cells(unique(spark, d), "chr1-chr1", 2_000, 18_000, 500)


@plan(_depth("SELECT chrom, greatest(2000, pos - 20) AS pos, 1 AS step FROM v UNION ALL SELECT chrom, least(18000, pos + 20), -1 FROM v").replace(", s AS", ", f AS (SELECT chrom, x, y FROM cis WHERE key = 'chr1-chr1' AND x >= 2000 AND y <= 18000 AND (x BETWEEN 4000 AND 6000 OR y BETWEEN 4000 AND 6000) AND NOT (x BETWEEN 4000 AND 6000 AND y BETWEEN 4000 AND 6000)), v AS (SELECT chrom, x AS pos FROM f UNION ALL SELECT chrom, y FROM f), s AS", 1)
      + ' SELECT chrom, start, e AS "end", depth::BIGINT AS depth, round(log2(depth), 6) AS log2_depth FROM r WHERE depth > 0')
def virtual4c(spark, d):
    return profiles.virtual_4c(unique(spark, d), "chr1-chr1", 2_000, 18_000, 4_000, 6_000).withColumn("log2_depth", F.round("log2_depth", 6))


@plan("SELECT sum(any_end)::BIGINT AS hits, (SELECT count(*) FROM pets) AS pets FROM (" + _COUNTS + ")")
def frif_1d(spark, d):
    return quantify.share_in_regions(unique(spark, d), tables.regions(spark, d), single=True)


@plan("SELECT sum(both_ends)::BIGINT AS hits, (SELECT count(*) FROM pets) AS pets FROM (" + _COUNTS + ")")
def frif_pairs(spark, d):
    return quantify.share_in_regions(unique(spark, d), tables.regions(spark, d))


@plan("SELECT sum(pets)::BIGINT AS hits FROM (" + _LOOPS + ")")
def frif_2d(spark, d):
    return intervals.loop_counts(unique(spark, d), tables.loops(spark, d)).agg(F.sum("pets").alias("hits"))


_NET = "SELECT a.region_id AS a, b.region_id AS b FROM regions a JOIN regions b ON a.chrom = b.chrom AND a.region_id < b.region_id AND a.s <= b.e AND b.s <= a.e"


@plan(f", e AS ({_NET}), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT DISTINCT a AS node, a AS r FROM u UNION SELECT reach.node, u.b FROM reach JOIN u ON u.a = reach.r) SELECT node, min(r) AS component FROM reach GROUP BY node")
def net_components(spark, d):
    r = tables.regions(spark, d)
    return network.components(intervals.overlaps(r, r).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


from contactloom.plans import calling, landscape  # noqa: E402,F401  they add their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every named query, of this module and the two that it loads."""
    return {name: (lambda spark, d, of=of: of(prepare(spark), d)) for name, (of, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
