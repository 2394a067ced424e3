"""Queries of noise filters, clusters, tests and callers."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.functions import tails
from contactloom.operators import cluster, differential, domains, estimates, intervals, matrix, peaks, pets, quantify, selection, tiles
from contactloom.operators import loops as lp
from contactloom.plans.common import dense, library, plan, raw, unique
from contactloom.sources import tables, tracks

_KNN = """, lo AS (SELECT key, min(x) AS ox, min(y) AS oy FROM cis GROUP BY key), p AS (SELECT key, x, y, (x - ox) // 2000 AS cx, (y - oy) // 2000 AS cy FROM cis JOIN lo USING (key)),
 g AS (SELECT key, cx, cy, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT a.key, a.cx, a.cy, sum(b.n) < 5 AS sparse FROM g a JOIN g b ON a.key = b.key AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY ALL),
 k AS (SELECT a.key, a.cx, a.cy FROM t a JOIN t b ON a.key = b.key AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY ALL HAVING NOT bool_and(b.sparse)) SELECT key, x, y FROM p JOIN k USING (key, cx, cy)"""


@plan(_KNN)
def filter_knn(spark, d):
    return cluster.denoised(unique(spark, d), 2_000, 5)


@plan("SELECT chrom_a, x, y FROM cis WHERE EXISTS (SELECT 1 FROM loops l WHERE l.chrom = cis.chrom AND (x BETWEEN sa AND ea OR y BETWEEN sa AND ea OR x BETWEEN sb AND eb OR y BETWEEN sb AND eb))")
def filter_any_anchor(spark, d):
    return lp.on_anchors(unique(spark, d), tables.loops(spark, d), 1).select("chrom_a", "x", "y")


@plan("SELECT cis.chrom, x, y FROM cis WHERE NOT EXISTS (SELECT 1 FROM loops l WHERE l.chrom = cis.chrom AND (x BETWEEN sa AND ea OR y BETWEEN sa AND ea) AND (x BETWEEN sb AND eb OR y BETWEEN sb AND eb))")
def filter_not_joining(spark, d):
    return intervals.joining(unique(spark, d), tables.loops(spark, d), inverse=True)


@plan("SELECT count(*) AS total_pets, count(*) FILTER (mapq >= 10) AS good_pets, count(dist) FILTER (mapq >= 10) AS cis_pets, count(*) FILTER (mapq >= 10 AND dist IS NULL) AS trans_pets, count(*) FILTER (mapq >= 10 AND dist < 1000) AS close_pets, count(*) FILTER (mapq >= 10 AND dist > 200000) AS far_pets,"
      " (SELECT count(*) FROM (SELECT DISTINCT key, x, y FROM c2 WHERE mapq >= 10 AND (dist IS NULL OR dist BETWEEN 1000 AND 200000))) AS unique_pets,"
      " round(1 - (SELECT count(*) FROM (SELECT DISTINCT key, x, y FROM c2 WHERE mapq >= 10 AND dist BETWEEN 1000 AND 200000)) / count(*) FILTER (mapq >= 10 AND dist BETWEEN 1000 AND 200000), 6) AS cis_redundancy FROM c2")
def pre_counts(spark, d):
    return pets.ingest_counts(raw(spark, d), 10, cut=1_000, mcut=200_000)


@plan("SELECT key, chrom_a = chrom_b AS cis, count(*) AS pets, min(x) AS min_x, max(y) AS max_y FROM pets GROUP BY ALL")
def update_catalog(spark, d):
    return pets.catalog(unique(spark, d))


@plan()
def sample_up(spark, d):
    p = unique(spark, d)
    return pets.sample_to(p, 100_000).select("key", "x", "y")


# estimates

@plan(", d AS (SELECT (y - o) // 10000 * 10000 - (x - o) // 10000 * 10000 AS distance, count(*) AS n FROM cis JOIN org USING (key) GROUP BY 1), s AS (SELECT distance, n / sum(n) OVER () AS share FROM d WHERE distance > 0) SELECT round(regr_slope(log10(share), log10(distance)), 6) AS slope, round(regr_intercept(log10(share), log10(distance)), 6) AS intercept, count(*) AS steps FROM s WHERE distance < 10000000")
def est_lr(spark, d):
    return estimates.decay_of_bins(unique(spark, d))


@plan()
def est_dis(spark, d):
    return estimates.distance_enrichment(unique(spark, d), 5_000, 3)


@plan()
def est_sat(spark, d):
    return estimates.saturation(dense(spark, d), (5_000, 10_000), ratios=(0.25, 0.5, 0.75))


@plan()
def sig_enrichment(spark, d):
    return estimates.enrichment_curves(dense(spark, d), 5_000, 2)


@plan("SELECT n, count(*) AS cells FROM (SELECT count(*) AS n FROM cis JOIN org USING (key) GROUP BY key, (x - o) // 5000, (y - o) // 5000) GROUP BY n")
def sig_distribution(spark, d):
    return estimates.cell_histogram(unique(spark, d), 5_000)


@plan(""", p AS (SELECT * FROM cis WHERE y < 12000), k AS (SELECT a.key, a.x, a.y, abs(a.x - b.x) + abs(a.y - b.y) AS d, row_number() OVER (PARTITION BY a.key, a.x, a.y ORDER BY abs(a.x - b.x) + abs(a.y - b.y)) AS i FROM p a JOIN p b USING (key)) SELECT key, x, y, d AS kdis FROM k WHERE i = 5
 UNION ALL SELECT key, x, y, NULL FROM p WHERE key IN (SELECT key FROM p GROUP BY key HAVING count(*) < 5)""")
def est_kdis(spark, d):
    return estimates.neighbour_distances(unique(spark, d).where("y < 12000"), 5)


@plan()
def est_eps(spark, d):
    p = unique(spark, d)
    return spark.createDataFrame([("mixture", estimates.mixture_eps(p)), ("knee", estimates.knee_eps(p))], "method string, eps long")


@plan()
def est_sim_pca(spark, d):
    got = estimates.principal_similarity({n: library(spark, d, n) for n in "FO"}, 20_000)
    return spark.createDataFrame([(a, b, float(got.loc[a, b])) for a in got.index for b in got.columns], "sample_a string, sample_b string, pcc double")


# tails and corrections; P(X >= k) summed from logarithms of terms

_COUNTED = ", n AS (SELECT r.region_id, r.e - r.s AS len, count(x) AS any_end, count(*) FILTER (x BETWEEN s AND e AND y BETWEEN s AND e) AS both_ends FROM regions r LEFT JOIN cis ON r.chrom = cis.chrom AND (x BETWEEN s AND e OR y BETWEEN s AND e) GROUP BY ALL)"


def _counts(spark, d):
    return intervals.region_counts(unique(spark, d), tables.regions(spark, d))


@plan(_COUNTED + ", q AS (SELECT region_id, any_end AS k, greatest(len / 200, 0.1)::DOUBLE AS mu FROM n) SELECT region_id, round(greatest(0, 1 - coalesce((SELECT sum(exp(i * ln(mu) - mu - lgamma(i + 1))) FROM generate_series(0, k - 1) t(i)), 0)), 6) AS p FROM q")
def poisson_tail(spark, d):
    mu = F.greatest(F.expr("end - start") / 200, F.lit(0.1))
    return _counts(spark, d).select("region_id", F.round(tails.poisson_sf(F.col("any_end").cast("double"), mu), 6).alias("p"))


@plan(_COUNTED + ", q AS (SELECT region_id, any_end AS k, any_end + len // 10 AS m, 0.2::DOUBLE AS p FROM n) SELECT region_id, round(1 - coalesce((SELECT sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + i * ln(p) + (m - i) * ln(1 - p))) FROM generate_series(0, k - 1) t(i)), 0), 6) AS p FROM q")
def binomial_tail(spark, d):
    m = F.col("any_end") + F.expr("(end - start) div 10")
    return _counts(spark, d).select("region_id", F.round(tails.binomial_sf(F.col("any_end").cast("double"), m.cast("double"), F.lit(0.2)), 6).alias("p"))


def _choose(n: str, m: str) -> str:
    return f"lgamma({n} + 1) - lgamma({m} + 1) - lgamma({n} - {m} + 1)"


@plan(_COUNTED + f", q AS (SELECT region_id, any_end // 2 AS k, any_end + 5 AS r, any_end + len // 20 AS d, 200 + any_end AS t FROM n) SELECT region_id, round(coalesce((SELECT sum(exp({_choose('r', 'i')} + {_choose('(t - r)', '(d - i)')} - ({_choose('t', 'd')}))) FROM generate_series(0, 400) g(i) WHERE i >= k AND i <= least(r, d) AND d - i <= t - r), 0), 6) AS p FROM q WHERE d <= t")
def hypergeometric_tail(spark, d):
    n = F.col("any_end")
    told = {"k": n - n % 2, "r": n + 5, "d": n + F.expr("(end - start) div 20"), "t": n + 200}
    rows = _counts(spark, d).select("region_id", (told["k"] / 2).alias("k"), *[told[c].cast("double").alias(c) for c in "rdt"]).where("d <= t")
    return rows.select("region_id", F.round(tails.hypergeometric_sf("k", "t", "r", "d"), 6).alias("p"))


@plan(_COUNTED + ", q AS (SELECT region_id, 1.0::DOUBLE / (1 + any_end * 40) AS p FROM n) SELECT region_id, round(least(1, p * count(*) OVER ()), 6) AS p, round(2 / (1 / p + 2 / p), 6) AS harmonic FROM q")
def corrections(spark, d):
    rows = _counts(spark, d).select("region_id", (1 / (1 + F.col("any_end") * 40)).alias("p"))
    n = F.lit(float(rows.count()))
    return rows.select("region_id", F.round(tails.bonferroni(F.col("p"), n), 6).alias("p"), F.round(tails.harmonic(F.array("p", F.col("p") / 2)), 6).alias("harmonic"))


# counts around peaks and loops

_DEN = ", dp AS (SELECT DISTINCT chrom, x, y FROM den)"


def _dense_points(spark, d):
    return intervals.points(dense(spark, d)).distinct()


def _dense_pets(spark, d, name=None):
    rows = dense(spark, d, name).drop("library")
    return rows if name else rows.distinct()


@plan(_DEN + """, w AS (SELECT region_id, chrom, e - s + 1 AS len, s, i, greatest(0, s - 1 + i * (e - s + 1)) AS ws, greatest(0, s - 1 + (i + 1) * (e - s + 1)) AS we FROM spots, generate_series(-10, 10) t(i) WHERE i <> 0),
 c AS (SELECT region_id, i, count(x) AS n FROM w LEFT JOIN dp ON dp.chrom = w.chrom AND x >= ws AND y <= we GROUP BY ALL),
 o AS (SELECT region_id, count(x) AS counts FROM spots LEFT JOIN dp ON dp.chrom = spots.chrom AND x >= s AND y <= e GROUP BY ALL)
 SELECT region_id::VARCHAR AS peak_id, counts, round(avg(n) FILTER (abs(i) <= 5), 6) AS mean5, round(avg(n), 6) AS mean10, round(median(n) FILTER (abs(i) <= 5), 6) AS median5, round(median(n), 6) AS median10 FROM c JOIN o USING (region_id) GROUP BY ALL""")
def peak_nearby(spark, d):
    r = tables.hub_regions(spark, d).selectExpr("CAST(region_id AS string) AS peak_id", "chrom", "start", "end", "end - start + 1 AS length")
    got = peaks.around(_dense_points(spark, d), r, 10)
    return got.select("peak_id", "counts", *[F.round(f(k), 6).alias(f"{n}{k}") for n, f in (("mean", peaks.near_mean), ("median", peaks.near_median)) for k in (5, 10)])


@plan(_DEN + """, i AS (SELECT region_id, s, e, greatest(s, x - 50) AS a, least(e, y + 50) AS b FROM spots JOIN dp ON dp.chrom = spots.chrom AND x >= s AND y <= e), v AS (SELECT DISTINCT region_id, a AS p FROM i WHERE a < b),
 c AS (SELECT v.region_id, p, count(*) AS n FROM v JOIN i ON i.region_id = v.region_id AND a <= p AND p < b GROUP BY ALL) SELECT region_id::VARCHAR AS peak_id, arg_min(p, (-n, p)) AS summit FROM c GROUP BY ALL""")
def peak_summits(spark, d):
    r = tables.hub_regions(spark, d).selectExpr("CAST(region_id AS string) AS peak_id", "chrom", "start", "end")
    return peaks.summits(_dense_points(spark, d), r)


def _rab(a: str, b: str) -> str:
    return f"(SELECT count(*) FROM dp WHERE dp.chrom = h.chrom AND (x BETWEEN {a} OR y BETWEEN {a}) AND (x BETWEEN {b} OR y BETWEEN {b}))"


_OWN_A, _OWN_B = "h.sa AND h.ea", "h.sb AND h.eb"


@plan(_DEN + f""", c AS (SELECT loop_id, {_rab(_OWN_A, _OWN_A)} AS ra, {_rab(_OWN_B, _OWN_B)} AS rb, {_rab(_OWN_A, _OWN_B)} AS rab, {_rab('h.ea AND 2 * h.ea - h.sa', '2 * h.sb - h.eb AND h.sb')} AS between_, {_rab('2 * h.sa - h.ea AND h.sa', '2 * h.sb - h.eb AND h.sb')} AS before_ FROM hubs h)
 SELECT loop_id, ra, rb, rab, round(rab / greatest(between_, 1), 6) AS p2ll_between, round(rab / greatest(before_, 1), 6) AS p2ll_before FROM c""")
def p2ll(spark, d):
    points, loops = _dense_points(spark, d), tables.hub_loops(spark, d)
    ratio = F.round(F.col("rab") / F.greatest(F.col("lower"), F.lit(1)), 6)
    between = lp.counted(points, loops).select("loop_id", "ra", "rb", "rab", ratio.alias("p2ll_between"))
    return between.join(lp.counted(points, loops, before=True).select("loop_id", ratio.alias("p2ll_before")), "loop_id")


_TILES = _DEN + """, m AS (SELECT *, (sa + ea) / 2 AS ca, (sb + eb) / 2 AS cb, (ea - sa) / 2 AS ha, (eb - sb) / 2 AS hb, (ea - sa + eb - sb) / 4 AS st FROM hubs),
 wa AS (SELECT loop_id, chrom, i, greatest(0, ca + i * st - ha) AS s, greatest(0, ca + i * st + ha) AS e FROM m, generate_series(-5, 5) t(i) WHERE i <> 0), wb AS (SELECT loop_id, chrom, j, greatest(0, cb + j * st - hb) AS s, greatest(0, cb + j * st + hb) AS e FROM m, generate_series(-5, 5) t(j) WHERE j <> 0),
 pa AS (SELECT loop_id, i, dp.chrom, x, y FROM wa JOIN dp ON dp.chrom = wa.chrom AND (x BETWEEN s AND e OR y BETWEEN s AND e)), pb AS (SELECT loop_id, j, dp.chrom, x, y FROM wb JOIN dp ON dp.chrom = wb.chrom AND (x BETWEEN s AND e OR y BETWEEN s AND e)),
 na AS (SELECT loop_id, i, count(*) AS n FROM pa GROUP BY ALL), nb AS (SELECT loop_id, j, count(*) AS n FROM pb GROUP BY ALL), ab AS (SELECT loop_id, i, j, count(*) AS n FROM pa JOIN pb USING (loop_id, chrom, x, y) GROUP BY ALL),
 g AS (SELECT wa.loop_id, wa.i, wb.j, coalesce(ab.n, 0) AS n, coalesce(ab.n / (na.n * nb.n), 0) AS dens FROM wa JOIN wb USING (loop_id) LEFT JOIN ab USING (loop_id, i, j) LEFT JOIN na USING (loop_id, i) LEFT JOIN nb USING (loop_id, j))"""


@plan(_TILES + " SELECT loop_id, round(median(n), 6) AS median, round(avg(n), 6) AS mean, round(median(dens), 9) AS median_density, round(avg(dens), 9) AS mean_density FROM g GROUP BY loop_id")
def loop_background(spark, d):
    loops = tables.hub_loops(spark, d)
    got = loops.select("loop_id").join(tiles.background(_dense_points(spark, d), loops), "loop_id", "left")
    got = got.withColumns({c: F.coalesce(c, F.array().cast(f"array<{t}>")) for c, t in (("tiles", "bigint"), ("densities", "double"))})
    told = {"median": F.round(tiles.padded_median(F.col("tiles"), 100), 6), "mean": F.round(tiles.padded_mean(F.col("tiles"), 100), 6),
            "median_density": F.round(tiles.padded_median(F.col("densities"), 100), 9), "mean_density": F.round(tiles.padded_mean(F.col("densities"), 100), 9)}
    return got.select("loop_id", *[c.alias(k) for k, c in told.items()])


@plan(_TILES + f", o AS (SELECT loop_id, {_rab(_OWN_A, _OWN_B)} AS rab FROM hubs h) SELECT loop_id, any_value(rab) AS rab, round(count(*) FILTER (n > rab) / 100, 6) AS fdr, round(any_value(rab) / greatest(median(n), 1), 6) AS es FROM g JOIN o USING (loop_id) GROUP BY loop_id")
def loop_es_fdr(spark, d):
    points, loops = _dense_points(spark, d), tables.hub_loops(spark, d)
    rows = lp._outcome(lp.counted(points, loops).join(tiles.background(points, loops), "loop_id", "left"), 5, False)
    return rows.select("loop_id", "rab", F.round("fdr", 6).alias("fdr"), F.round(F.col("rab") / F.greatest("around", F.lit(1.0)), 6).alias("es"))


@plan(_DEN + f""", tot AS (SELECT chrom, count(*) / (max(y) - min(x)) AS rpb FROM dp GROUP BY chrom), a AS (SELECT loop_id, chrom, ea - sa AS len, {_rab(_OWN_A, _OWN_A)} AS n, {_rab('greatest(0, (h.sa + h.ea) / 2 - 5 * (h.ea - h.sa)) AND (h.sa + h.ea) / 2 + 5 * (h.ea - h.sa)', 'greatest(0, (h.sa + h.ea) / 2 - 5 * (h.ea - h.sa)) AND (h.sa + h.ea) / 2 + 5 * (h.ea - h.sa)')} AS w FROM hubs h)
 SELECT loop_id, n AS ra, round(n / greatest((w - n) / 10, rpb * len, 1), 6) AS es_a FROM a JOIN tot USING (chrom)""")
def anchor_enrichment(spark, d):
    points = _dense_points(spark, d)
    rows = lp.anchor_test(lp.counted(points, tables.hub_loops(spark, d)).join(F.broadcast(lp.totals(points)), "chrom"))
    return rows.select("loop_id", "ra", F.round("es_a", 6).alias("es_a"))


# clusters and callers: no SQL says them, tests hold them against plain versions

@plan()
def cluster_grid(spark, d):
    return cluster.boxes(cluster.grid_clusters(_dense_points(spark, d).withColumnRenamed("chrom", "key"), 500, 10))


@plan()
def cluster_exact(spark, d):
    return cluster.boxes(cluster.exact_clusters(_dense_points(spark, d).withColumnRenamed("chrom", "key"), 60, 5))


@plan()
def call_loops(spark, d):
    return lp.call_cis(_dense_pets(spark, d), (500,), (10,))


@plan()
def call_loops_matrix(spark, d):
    return lp.call_cis(_dense_pets(spark, d), (300,), (10,), hic=True)


@plan()
def trans_candidates(spark, d):
    return lp.candidates(lp.trans_points(unique(spark, d)), (2_000,), (6,), trans=True)


@plan()
def call_trans_loops(spark, d):
    # the tables hold chance only between chromosomes, so tests are shown, significant or not
    points = lp.trans_points(unique(spark, d)).checkpoint()
    return lp.marked_trans(lp.trans_tests(points, lp.candidates(points, (2_000,), (6,), trans=True).checkpoint(), 6))


@plan()
def call_peaks(spark, d):
    return peaks.call(pets.keep(_dense_pets(spark, d).withColumn("mapq", F.lit(255)), mcut=1_000), (100,), (5,))


@plan()
def call_peaks_control(spark, d):
    target, control = (pets.keep(_dense_pets(spark, d, n).withColumn("mapq", F.lit(255)), mcut=1_000) for n in "FO")
    return peaks.call(target, (100,), (5,), control=control.where("x % 3 = 0"), by_ratio=True)


@plan()
def call_domains(spark, d):
    return domains.call(_dense_pets(spark, d), (10_000,), (100_000,))


@plan()
def segregation_scores(spark, d):
    return domains.segregation(_dense_pets(spark, d), 10_000, 100_000)


@plan()
def call_diff_loops(spark, d):
    known = tables.hub_loops(spark, d)
    return differential.call(_dense_pets(spark, d, "F"), _dense_pets(spark, d, "O"), known.where("loop_id <= 60"), known.where("loop_id > 20"))


_DIFF = _DEN.replace("dp AS (SELECT DISTINCT chrom, x, y FROM den)", "t AS (SELECT chrom, x, y FROM den WHERE library = 'F'), c AS (SELECT chrom, x, y FROM den WHERE library = 'O')")
_BOTH = "(x BETWEEN h.sa AND h.ea OR y BETWEEN h.sa AND h.ea) AND (x BETWEEN h.sb AND h.eb OR y BETWEEN h.sb AND h.eb)"


@plan(_DIFF + f", n AS (SELECT loop_id, (SELECT count(*) FROM t WHERE t.chrom = h.chrom AND {_BOTH}) AS rab_t, (SELECT count(*) FROM c WHERE c.chrom = h.chrom AND {_BOTH}) AS rab_c FROM hubs h)"
      " SELECT loop_id || '|t|' || loop_id || '|c' AS loop_id, rab_t, rab_c, round(log2(rab_t / (SELECT count(*) FROM t)) - log2(rab_c / (SELECT count(*) FROM c)), 6) AS raw_fc, (abs(log2(rab_t) - log2(rab_c)) >= 0.5 AND (log2(greatest(rab_c, 1)) + log2(greatest(rab_t, 1))) / 2 >= 2)::INT AS significant FROM n WHERE rab_t > 0 AND rab_c > 0")
def diff_mark(spark, d):
    t, c, known = dense(spark, d, "F"), dense(spark, d, "O"), tables.hub_loops(spark, d)
    rows = differential.counted(t, c, selection.united_loops(known, known, "t", "c")).where("rab_t > 0 AND rab_c > 0")
    rows = differential.marked(differential.tested(rows, (1.0, 0.0), t.count(), c.count()), 2.0, 0.5, ignore_p=True)
    return rows.select("loop_id", "rab_t", "rab_c", F.round("raw_fc", 6).alias("raw_fc"), "significant")


@plan(_DEN + f""", c AS (SELECT loop_id, chrom, sa, ea, sb, eb, {_rab(_OWN_A, _OWN_B)} AS rab FROM hubs h) SELECT loop_id, rab, round(rab / (ea - sa + eb - sb) / (SELECT count(*) FROM dp) * 1e9, 6) AS density FROM c""")
def quant_loops_counts(spark, d):
    p = _dense_pets(spark, d)
    return quantify.loops(p, tables.hub_loops(spark, d), p.count(), counts_only=True).select("loop_id", "rab", F.round("density", 6).alias("density"))


@plan()
def quant_loops(spark, d):
    p = _dense_pets(spark, d)
    return quantify.loops(p, tables.hub_loops(spark, d), p.count())


@plan(_DEN + """, o AS (SELECT region_id, spots.chrom, s, e, count(x) AS counts FROM spots LEFT JOIN dp ON dp.chrom = spots.chrom AND x >= s AND y <= e GROUP BY ALL), r AS (SELECT chrom, count(*) / (max(y) - min(x)) AS rpb FROM dp GROUP BY chrom)
 SELECT region_id::VARCHAR AS peak_id, counts, round(counts / (e - s) / (SELECT count(*) FROM dp) * 1e9, 6) AS density, round(counts / (rpb * (e - s)), 6) AS chance FROM o JOIN r USING (chrom)""")
def quant_peaks(spark, d):
    p = _dense_pets(spark, d)
    r = tables.hub_regions(spark, d).selectExpr("CAST(region_id AS string) AS peak_id", "chrom", "start", "end", "end - start AS length")
    return quantify.peaks(p, r, p.count()).select("peak_id", "counts", F.round("density", 6).alias("density"), F.round(F.get("escores", F.lit(2)), 6).alias("chance"))


@plan()
def quant_domains(spark, d):
    p = _dense_pets(spark, d)
    known = tables.hub_loops(spark, d).selectExpr("chrom", "start_a AS start", "end_b AS end", "end_b - start_a AS length")
    return quantify.domains(p, known, p.count(), 10_000, 100_000)


@plan("SELECT r.region_id, r.chrom, s AS start, e AS \"end\", any_end + both_ends AS all_pets, 2 * both_ends AS local_pets, any_end - both_ends AS distal_pets, round((any_end + both_ends) / nullif(e - s, 0) / n / 2 * 1e9, 6) AS all_rpkm, round(2 * both_ends / nullif(e - s, 0) / n / 2 * 1e9, 6) AS local_rpkm, round((any_end - both_ends) * 2 / nullif(e - s, 0) / n / 2 * 1e9, 6) AS distal_rpkm FROM (SELECT r.region_id, r.chrom, r.s, r.e, count(x) AS any_end, count(*) FILTER (x BETWEEN s AND e AND y BETWEEN s AND e) AS both_ends FROM regions r LEFT JOIN cis ON r.chrom = cis.chrom AND (x BETWEEN s AND e OR y BETWEEN s AND e) GROUP BY ALL) r JOIN (SELECT chrom, count(*) AS n FROM cis GROUP BY chrom) USING (chrom)")
def int_density(spark, d):
    got = quantify.regions(unique(spark, d), tables.regions(spark, d))
    return got.select(*[F.round(c, 6).alias(c) if c.endswith("rpkm") else c for c in got.columns])


@plan("SELECT 'hub_' || loop_id AS loop_id, chrom || ':' || sa || '-' || ea AS anchor_a, chrom || ':' || sb || '-' || eb AS anchor_b, '1' AS score FROM hubs")
def loop_links(spark, d):
    rows = tables.hub_loops(spark, d).withColumns({"significant": F.lit(1), "name": F.concat(F.lit("hub_"), "loop_id")})
    lines = tracks.loop_link_lines(rows)
    return rows.select(F.col("name").alias("loop_id"), F.format_string("%s:%d-%d", "chrom", "start_a", "end_a").alias("anchor_a")).join(lines, "anchor_a")


@plan("SELECT chrom, sa AS start, ea AS \"end\", chrom || ':' || sb || '-' || eb || ',' || loop_id AS partner FROM hubs UNION ALL SELECT chrom, sb, eb, chrom || ':' || sa || '-' || ea || ',' || loop_id FROM hubs")
def loop_mirrored(spark, d):
    return tracks.loop_mirror_lines(tables.hub_loops(spark, d).withColumn("significant", F.lit(1)), score="loop_id")


@plan("SELECT count(*) AS cells, sum(n)::BIGINT AS pets FROM (SELECT count(*) AS n FROM cis JOIN org USING (key) GROUP BY key, (x - o) // 20000, (y - o) // 20000)")
def shuffled_pairs(spark, d):
    # dealing ends anew keeps every end: only totals are certain
    p = unique(spark, d)
    s = matrix.shuffled(p, 1)
    cells = matrix.bins(p, 20_000).agg(F.count(F.lit(1)).alias("cells"))
    return cells.withColumn("pets", F.lit(s.count()))
