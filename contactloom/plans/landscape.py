"""Queries of profiles, borders, annotation, networks, comparisons, signals, reads and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.functions import tails
from contactloom.operators import annotate, compare, differential, domains, profiles, reads, signals
from contactloom.plans.calling import _DEN, _dense_pets
from contactloom.plans.common import plan, raw, unique
from contactloom.sources import formats, tables

# profiles and matrices around regions

_PEAKS = ", w AS (SELECT region_id, chrom, greatest(0, (s + e) / 2 - 1000)::BIGINT AS a, ((s + e) / 2 + 1000)::BIGINT AS b FROM (SELECT region_id, chrom, s - s % 2 AS s, e - e % 2 AS e FROM spots)), t AS (SELECT chrom, x AS p FROM dp UNION ALL SELECT chrom, y FROM dp)"


@plan(_DEN + _PEAKS + """, o AS (SELECT region_id, greatest(p - 20, a) - a AS lo, least(p + 20, b) - a AS hi, (b - a) // 50 AS w FROM w JOIN t ON t.chrom = w.chrom AND p BETWEEN a AND b), z AS (SELECT * FROM o WHERE lo < hi)
 SELECT region_id, i::INT AS bin, round(sum(least(hi, (i + 1) * w) - greatest(lo, i * w)) / any_value(w) / (2 * (SELECT count(*) FROM dp)) * 1e6, 6) AS value FROM z, generate_series(0, 49) g(i) WHERE i * w < hi AND (i + 1) * w > lo GROUP BY ALL""")
def agg_profile(spark, d):
    p = _dense_pets(spark, d)
    r = tables.hub_regions(spark, d).selectExpr("region_id", "chrom", "start - start % 2 AS start", "end - end % 2 AS end")
    return profiles.peak_profiles(p, r, p.count(), 1_000, 50).withColumn("value", F.round("value", 6))


@plan(_DEN + """, v AS (SELECT loop_id, i, j, count(*) AS n FROM hubs, generate_series(-5, 5) a(i), generate_series(-5, 5) b(j), dp WHERE dp.chrom = hubs.chrom
 AND (x BETWEEN greatest(0, sa + i * 800) AND greatest(0, sa + (i + 1) * 800) OR y BETWEEN greatest(0, sa + i * 800) AND greatest(0, sa + (i + 1) * 800))
 AND (x BETWEEN greatest(0, sb + j * 800) AND greatest(0, sb + (j + 1) * 800) OR y BETWEEN greatest(0, sb + j * 800) AND greatest(0, sb + (j + 1) * 800)) AND loop_id <= 6 GROUP BY ALL) SELECT loop_id, i::INT AS i, j::INT AS j, n FROM v""")
def agg_loop_tiles(spark, d):
    return profiles.loop_tiles(_dense_pets(spark, d), tables.hub_loops(spark, d).where("loop_id <= 6"))


@plan()
def agg_loops_mean(spark, d):
    loops = tables.hub_loops(spark, d)
    _, es = differential.mean_tiles(profiles.loop_tiles(_dense_pets(spark, d), loops))
    return es


_SPANS = ", s AS (SELECT loop_id AS region_id, chrom, (sa - 0.25 * (eb - sa))::DOUBLE AS a, floor((eb + 0.25 * (eb - sa) - (sa - 0.25 * (eb - sa))) / 20)::BIGINT AS w FROM hubs WHERE loop_id BETWEEN 10 AND 20), g AS (SELECT region_id, chrom, i, a + i * w AS lo, a + (i + 1) * w AS hi FROM s, generate_series(0, 19) t(i)), h AS (SELECT region_id, i, dp.chrom, x, y FROM g JOIN dp ON dp.chrom = g.chrom AND (x BETWEEN lo AND hi OR y BETWEEN lo AND hi))"


@plan(_DEN + _SPANS + " SELECT a.region_id, a.i::INT AS i, b.i::INT AS j, count(*) AS n FROM h a JOIN h b USING (region_id, chrom, x, y) GROUP BY ALL")
def agg_two_anchors(spark, d):
    return profiles.span_tiles(_dense_pets(spark, d), profiles.span_windows(tables.hub_loops(spark, d).where("loop_id BETWEEN 10 AND 20"), 0.25), 20)


@plan()
def agg_domains(spark, d):
    known = tables.hub_loops(spark, d).selectExpr("loop_id AS region_id", "chrom", "start_a AS start", "end_b AS end")
    return profiles.mean_cells(profiles.span_tiles(_dense_pets(spark, d), profiles.domain_windows(known, 0.5), 50), known.count(), norm=True)


@plan(_DEN + """, v AS (SELECT region_id, chrom, (s + e) / 2 - 10000 AS a, (s + e) / 2 + 10000 AS b FROM spots WHERE (s + e) / 2 > 10000), c AS (SELECT region_id, floor((x - a) / 1000)::INT AS i, floor((y - a) / 1000)::INT AS j FROM v JOIN dp ON dp.chrom = v.chrom AND x >= a AND y <= b)
 SELECT region_id, i, j, count(*) AS n FROM (SELECT * FROM c UNION ALL SELECT region_id, j, i FROM c) WHERE i < 20 AND j < 20 GROUP BY ALL""")
def agg_viewpoints(spark, d):
    return profiles.viewpoint_cells(_dense_pets(spark, d), tables.hub_regions(spark, d), 10_000, 10_000, 1_000)


_BINS = "region_id, (i)::INT AS bin, round(sum((least(e, b) - greatest(s, a)) * v), 6) AS total"


@plan(", r AS (SELECT region_id, chrom, s AS rs, (e - s) // 10 AS w FROM regions WHERE e - s >= 200), g AS (SELECT region_id, chrom, i, w, rs + i * w AS a, rs + (i + 1) * w AS b FROM r, generate_series(0, 9) t(i)) SELECT " + _BINS + " FROM g JOIN signal ON signal.chrom = g.chrom AND s < b AND e > a GROUP BY region_id, i")
def signal_profiles(spark, d):
    r = tables.regions(spark, d).where("end - start >= 200")
    # means times the width of a bin: sums have as many places as the values, so no rounding is a tie
    got = profiles.signal_profiles(tables.signal(spark, d), r, 10).join(r.selectExpr("region_id", "(end - start) div 10 AS w"), "region_id")
    return got.select("region_id", "bin", F.round(F.col("value") * F.col("w"), 6).alias("total"))


@plan(", h AS (SELECT region_id, chrom, x, y FROM regions r JOIN cis USING (chrom) WHERE x BETWEEN s AND e OR y BETWEEN s AND e) SELECT a.region_id AS id_a, b.region_id AS id_b, count(*) AS n, round(count(*) / (SELECT count(*) FROM pets) * 1e6, 6) AS per_million FROM h a JOIN h b ON a.chrom = b.chrom AND a.x = b.x AND a.y = b.y AND a.region_id < b.region_id GROUP BY ALL")
def montage_counts(spark, d):
    p = unique(spark, d)
    return profiles.region_links(p, tables.regions(spark, d), p.count()).withColumn("per_million", F.round("per_million", 6))


# borders

_SIGNAL = ", b AS (SELECT chrom, s // 3000 * 3000 AS p, round(avg(v), 6) AS v FROM signal GROUP BY ALL)"


@plan(_SIGNAL + ", k AS (SELECT chrom, p, v, p // 3000 - row_number() OVER (PARTITION BY chrom ORDER BY p) AS run FROM b WHERE v > 0) SELECT chrom, min(p) AS start, max(p) + 3000 AS \"end\", max(p) + 3000 - min(p) AS length, round(avg(v), 6) AS ss FROM k GROUP BY chrom, run HAVING count(*) >= 2")
def domain_islands(spark, d):
    rows = tables.bins_of_signal(spark, d, 3_000).select(F.concat_ws("-", "chrom", "chrom").alias("key"), F.expr("start div 3000").alias("i"), "start", "end", F.col("value").alias("ss"))
    return domains.islands(rows, 3_000, least=0).withColumn("ss", F.round("ss", 6))


@plan(_SIGNAL + """, k AS (SELECT *, CASE WHEN lag(sign(v)) OVER w IS DISTINCT FROM sign(v) OR v = 0 THEN 1 ELSE 0 END AS o FROM b WINDOW w AS (PARTITION BY chrom ORDER BY p)), r AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY p) AS run FROM k)
 SELECT chrom, min(p) AS start, max(p) + 3000 AS "end", CASE WHEN max(v) > 0 THEN 'A' ELSE 'B' END AS compartment, round(avg(v), 6) AS value FROM r GROUP BY chrom, run""")
def compartment_islands(spark, d):
    return domains.compartments(tables.bins_of_signal(spark, d, 3_000)).withColumn("value", F.round("value", 6))


def _pass(of: str) -> str:
    return f"(SELECT avg(va) AS ma, avg(vb) AS mb, var_samp(va) AS aa, var_samp(vb) AS bb, covar_samp(va, vb) AS ab FROM {of})"


_D2 = "((va - ma) * (va - ma) * bb - 2 * (va - ma) * (vb - mb) * ab + (vb - mb) * (vb - mb) * aa) / (aa * bb - ab * ab)"
#: Fixed value: the squared distance at which one degree of freedom has p = 0.01.
_CUT = 6.6348966010212145
_TWO = f""", pa AS (SELECT chrom, s // 9000 * 9000 AS p, round(avg(v), 6) AS va FROM signal WHERE event_type <> 'click' GROUP BY ALL), pb AS (SELECT chrom, s // 9000 * 9000 AS p, round(avg(v), 6) AS vb FROM signal WHERE event_type = 'click' GROUP BY ALL),
 j AS (SELECT * FROM pa JOIN pb USING (chrom, p)), f AS (SELECT j.*, {_D2} AS d FROM j, {_pass('j')}), t AS (SELECT chrom, p, va, vb, {_D2} AS d2 FROM f, {_pass(f'(SELECT * FROM f WHERE d <= {_CUT})')})"""


def _two_signals(spark, d):
    return [tables.bins_of_signal(spark, d, 9_000, w) for w in ("event_type <> 'click'", "event_type = 'click'")]


@plan(_TWO + " SELECT chrom, p AS start, round(d2, 5) AS d2 FROM t")
def mahalanobis_two_pass(spark, d):
    a, b = _two_signals(spark, d)
    both = a.withColumnRenamed("value", "va").join(b.withColumnRenamed("value", "vb"), ["chrom", "start", "end"])
    return tails.two_pass_mahalanobis(both, "va", "vb").select("chrom", "start", F.round("d2", 5).alias("d2"))


@plan(_TWO + f" SELECT chrom, p AS start, CASE WHEN d2 > {_CUT} THEN (CASE WHEN va > 0 THEN 'A' ELSE 'B' END) || 'to' || (CASE WHEN vb > 0 THEN 'A' ELSE 'B' END) END AS flip FROM t")
def compartment_flips(spark, d):
    return compare.compartment_bins(*_two_signals(spark, d)).select("chrom", "start", "flip")


@plan(_SIGNAL.replace("3000", "9000") + ", o AS (SELECT DISTINCT b.chrom, p, gene_id FROM b JOIN genes g ON g.chrom = b.chrom AND gs < p + 9000 AND ge > p) SELECT chrom, p AS start, string_agg(gene_id, ',' ORDER BY gene_id) AS genes FROM o GROUP BY ALL")
def annotated_bins(spark, d):
    rows = tables.bins_of_signal(spark, d, 9_000)
    genes = tables.genes(spark, d)
    got = compare.annotated_bins(rows, domains.compartments(rows), genes).where("genes IS NOT NULL")
    return got.select("chrom", "start", F.array_join(F.transform("genes", lambda g: g.cast("string")), ",").alias("genes"))


_DOMS = """, q AS (SELECT loop_id, chrom, sa AS s, eb AS e FROM hubs), m AS (SELECT chrom || ':' || s || '-' || e AS domain_id, library, count(*) FILTER (x >= s AND y <= e) AS i, count(*) AS t FROM q JOIN den USING (chrom) WHERE x BETWEEN s AND e OR y BETWEEN s AND e GROUP BY ALL)"""


@plan(_DOMS + " SELECT domain_id, max(t) FILTER (library = 'F') AS total_a, max(i) FILTER (library = 'F') AS internal_a, round(max(i / (t - i)) FILTER (library = 'F'), 6) AS es_a, max(t) FILTER (library = 'O') AS total_b, round(max(i / (t - i)) FILTER (library = 'O'), 6) AS es_b FROM m GROUP BY domain_id HAVING min(t - i) > 0 AND count(*) = 2")
def compare_domains(spark, d):
    known = tables.hub_loops(spark, d).selectExpr("chrom", "start_a AS start", "end_b AS end")
    got = compare.domains(_dense_pets(spark, d, "F"), _dense_pets(spark, d, "O"), known)
    return got.select("domain_id", "total_a", "internal_a", F.round("es_a", 6).alias("es_a"), "total_b", F.round("es_b", 6).alias("es_b"))


# annotation and networks

_STARTS = """, sides AS (SELECT loop_id, 'a' AS side, chrom, sa AS s, ea AS e FROM loops UNION ALL SELECT loop_id, 'b', chrom, sb, eb FROM loops), inn AS (SELECT loop_id, side, list(gene_id ORDER BY gene_id) AS genes, 0 AS dist FROM sides JOIN genes USING (chrom) WHERE tss BETWEEN s AND e GROUP BY ALL),
 near AS (SELECT loop_id, side, [arg_min(gene_id, (abs(2 * tss - s - e), gene_id))] AS genes, min(abs(2 * tss - s - e)) // 2 AS dist FROM sides JOIN genes USING (chrom) WHERE (loop_id, side) NOT IN (SELECT (loop_id, side) FROM inn) GROUP BY ALL),
 told AS (SELECT *, CASE WHEN len(genes) > 1 OR dist <= 2000 THEN 'Promoter' ELSE 'Enhancer' END AS kind FROM (SELECT * FROM inn UNION ALL SELECT * FROM near))"""


@plan(_STARTS + " SELECT a.loop_id, a.kind AS kind_a, a.dist AS distance_a, array_to_string(a.genes, ',') AS genes_a, b.kind AS kind_b, b.dist AS distance_b, array_to_string(b.genes, ',') AS genes_b FROM told a JOIN told b ON a.loop_id = b.loop_id AND a.side = 'a' AND b.side = 'b'")
def annotate_anchors(spark, d):
    got = annotate.loop_genes(tables.loops(spark, d), tables.genes(spark, d))
    return got.select("loop_id", *[c for s in "ab" for c in (f"kind_{s}", f"distance_{s}", F.array_join(F.transform(f"genes_{s}", lambda g: g.cast("string")), ",").alias(f"genes_{s}"))])


_NET = """, l AS (SELECT * FROM loops WHERE loop_id % 9 = 1), an AS (SELECT chrom, sa AS s, ea AS e FROM l UNION ALL SELECT chrom, sb, eb FROM l), mx AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM an),
 rn AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM mx), ms AS (SELECT chrom, min(s) AS s, max(e) AS e FROM rn GROUP BY chrom, run),
 inn AS (SELECT chrom, s, e, count(*) AS n, 0 AS dist FROM ms JOIN genes USING (chrom) WHERE tss BETWEEN s AND e GROUP BY ALL), near AS (SELECT chrom, s, e, 1 AS n, min(abs(2 * tss - s - e)) // 2 AS dist FROM ms JOIN genes USING (chrom) WHERE (chrom, s, e) NOT IN (SELECT (chrom, s, e) FROM inn) GROUP BY ALL),
 ma AS (SELECT *, chrom || ':' || s || '-' || e || '|' || CASE WHEN n > 1 OR dist <= 2000 THEN 'Promoter' ELSE 'Enhancer' END AS anchor FROM (SELECT * FROM inn UNION ALL SELECT * FROM near)),
 ab AS (SELECT DISTINCT least(a.anchor, b.anchor) AS a, greatest(a.anchor, b.anchor) AS b FROM l JOIN ma a ON a.chrom = l.chrom AND sa BETWEEN a.s AND a.e JOIN ma b ON b.chrom = l.chrom AND sb BETWEEN b.s AND b.e WHERE a.anchor <> b.anchor)"""


def _network(spark, d):
    loops = tables.loops(spark, d).where("loop_id % 9 = 1")
    anchors = annotate.merged_anchors(loops, tables.genes(spark, d)).checkpoint()
    return anchors, annotate.links(annotate.loop_anchors(loops, anchors)).checkpoint()


@plan(_NET + " SELECT a, CASE WHEN a LIKE '%Enhancer' AND b LIKE '%Enhancer' THEN 'Enhancer-Enhancer' WHEN a LIKE '%Promoter' AND b LIKE '%Promoter' THEN 'Promoter-Promoter' ELSE 'Enhancer-Promoter' END AS type, b FROM ab")
def net_edges(spark, d):
    return _network(spark, d)[1]


_REACH = ", u AS (SELECT a, b FROM ab UNION ALL SELECT b, a FROM ab), reach AS (SELECT DISTINCT a AS node, a AS r FROM u WHERE a LIKE '%Promoter' UNION SELECT reach.node, u.b FROM reach JOIN u ON u.a = reach.r)"


@plan(_NET + _REACH + """ SELECT node AS promoter, count(*) FILTER (d AND r LIKE '%Enhancer') AS direct_enhancers, count(*) FILTER (NOT d AND r LIKE '%Enhancer') AS indirect_enhancers, count(*) FILTER (d AND r LIKE '%Promoter') AS direct_promoters, count(*) FILTER (NOT d AND r LIKE '%Promoter') AS indirect_promoters
 FROM (SELECT node, r, EXISTS (SELECT 1 FROM u WHERE u.a = node AND u.b = r) AS d FROM reach WHERE node <> r) GROUP BY node""")
def net_targets(spark, d):
    got = annotate.promoter_targets(_network(spark, d)[1])
    return got.select("promoter", *[F.size(c).cast("long").alias(c) for c in ("direct_enhancers", "indirect_enhancers", "direct_promoters", "indirect_promoters")])


@plan()
def net_hubs(spark, d):
    return annotate.hub_scores(_network(spark, d)[1])


@plan(_NET + """, u AS (SELECT a, b FROM ab UNION ALL SELECT b, a FROM ab), q AS (SELECT DISTINCT region_id, u.a AS node FROM regions JOIN ma ON ma.chrom = regions.chrom AND regions.s < ma.e + 1 AND regions.e > ma.s JOIN u ON u.a = ma.anchor WHERE region_id % 50 = 0),
 reach AS (SELECT DISTINCT node, node AS r FROM q UNION SELECT reach.node, u.b FROM reach JOIN u ON u.a = reach.r), t AS (SELECT node, r, (node = r OR (node LIKE '%Enhancer' AND EXISTS (SELECT 1 FROM u WHERE u.a = node AND u.b = r))) AS d FROM reach WHERE r LIKE '%Promoter')
 SELECT region_id, node AS anchor, count(*) FILTER (d) AS direct, count(*) FILTER (NOT d) AS indirect FROM q JOIN t USING (node) GROUP BY ALL""")
def net_bfs_targets(spark, d):
    anchors, edges = _network(spark, d)
    queries = tables.regions(spark, d).where("region_id % 50 = 0")
    found, _ = annotate.region_targets(edges, anchors.select("anchor", F.col("anchor").alias("genes")), queries)
    return found.select("region_id", "anchor", F.size("direct_genes").cast("long").alias("direct"), F.size("indirect_genes").cast("long").alias("indirect"))


@plan("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN (ae AND bp) OR (ap AND be) THEN 'Enhancer-Promoter' WHEN ae AND be THEN 'Enhancer-Enhancer' WHEN ap AND bp THEN 'Promoter-Promoter' WHEN (ae AND NOT be AND NOT bp) OR (be AND NOT ae AND NOT ap) THEN 'Enhancer-Other' WHEN (ap AND NOT be AND NOT bp) OR (bp AND NOT ae AND NOT ap) THEN 'Promoter-Other' ELSE 'Other-Other' END AS kind
 FROM (SELECT EXISTS (SELECT 1 FROM regions r WHERE r.region_id % 3 = 0 AND r.chrom = chrom_a AND x - 50 < e AND x + 50 > s) AS ae, EXISTS (SELECT 1 FROM regions r WHERE r.region_id % 3 = 1 AND r.chrom = chrom_a AND x - 50 < e AND x + 50 > s) AS ap,
 EXISTS (SELECT 1 FROM regions r WHERE r.region_id % 3 = 0 AND r.chrom = chrom_b AND y - 50 < e AND y + 50 > s) AS be, EXISTS (SELECT 1 FROM regions r WHERE r.region_id % 3 = 1 AND r.chrom = chrom_b AND y - 50 < e AND y + 50 > s) AS bp FROM pets)) GROUP BY kind""")
def pets_annotation(spark, d):
    r = tables.regions(spark, d)
    return annotate.pair_classes(unique(spark, d), r.where("region_id % 3 = 0"), r.where("region_id % 3 = 1"))


# signals

@plan(", a AS (SELECT * FROM regions WHERE region_id % 7 = 1), b AS (SELECT * FROM regions WHERE region_id % 7 IN (1, 3)), m AS (SELECT DISTINCT a.chrom, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM a JOIN b ON a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e), k AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM m), z AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM k) SELECT chrom, min(s) AS start, max(e) AS \"end\" FROM z GROUP BY chrom, run")
def shared_regions(spark, d):
    r = tables.regions(spark, d)
    return signals.shared_regions(r.where("region_id % 7 = 1"), r.where("region_id % 7 IN (1, 3)"))


@plan()
def signal_background(spark, d):
    r = tables.regions(spark, d).where("end - start < 400")
    return signals.shifted_regions(r.where("region_id % 50 = 1"), r.where("region_id % 50 = 3"), 2)


@plan()
def signal_normalised(spark, d):
    s = tables.signal(spark, d).withColumn("value", F.abs("value") + 0.5)
    r = tables.regions(spark, d).where("end - start < 400")
    _, b = signals.normalise(s, s.withColumn("value", F.col("value") * 2 + 1), r.where("region_id % 40 = 1"), r.where("region_id % 40 IN (1, 3)"), 10)
    return b


# reads and conversions

_LINKER = reads.LINKER
_TURNED = reads.LINKER[::-1].translate(str.maketrans("ACTG", "TGAC"))
_READS = f""", o AS (SELECT o_orderkey AS k, translate(md5('a' || o_orderkey), '0123456789abcdef', 'ACGTACGTACGTACGT') AS a, translate(md5('b' || o_orderkey), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b FROM orders),
 rd AS (SELECT lpad(k::VARCHAR, 12, '0') AS name, CASE WHEN k % 3 = 0 THEN left(a, k % 30) || '{_LINKER}' || b ELSE a END AS ra, CASE WHEN k % 5 = 0 THEN left(b, k % 25) || '{_LINKER}' || a ELSE b END AS rb FROM o)"""


def _first(seq: str) -> str:
    f, r = (f"instr({seq}, '{s[:9]}')" for s in (_LINKER, _TURNED))
    return f"coalesce(least(nullif({f}, 0), nullif({r}, 0)), 0) - 1"


@plan(_READS + f", p AS (SELECT row_number() OVER (ORDER BY name) AS i, ra, rb, {_first('ra')} AS pa, {_first('rb')} AS pb FROM rd), c AS (SELECT i || '_' || pa || '_' || pb AS name, CASE WHEN pa < 0 THEN ra ELSE left(ra, pa) END AS seq_a, CASE WHEN pb < 0 THEN rb ELSE left(rb, pb) END AS seq_b FROM p) SELECT name, seq_a, repeat('F', length(seq_a)) AS qual_a, seq_b, repeat('F', length(seq_b)) AS qual_b FROM c WHERE length(seq_a) >= 10 AND length(seq_b) >= 10")
def linker_trim(spark, d):
    return reads.cut_linkers(tables.read_pairs(spark, d, _LINKER))


@plan(_READS + """, m AS (SELECT name, ra, (substr(ra, 1, 1) <> 'A')::INT + (substr(ra, 2, 1) <> 'C')::INT + (substr(ra, 3, 1) <> 'G')::INT + (substr(ra, 4, 1) <> 'T')::INT AS miss, instr(substr(ra, 5), 'CA') + 4 AS p FROM rd WHERE length(ra) >= 4)
 SELECT name, substr(ra, p + 3) AS seq, repeat('F', length(ra) - p - 2) AS qual FROM m WHERE miss <= 2 AND p > 4 AND length(ra) - (p + 2) > 10""")
def bait_match(spark, d):
    rows = tables.read_pairs(spark, d, _LINKER).selectExpr("name", "seq_a AS seq", "qual_a AS qual")
    return reads.baited(rows, "ACGT", "CA")


_FRAGMENTS = ", f AS (SELECT chrom, s - s % 500 AS fs, s - s % 500 + 500 AS fe FROM regions), five AS (SELECT chrom_a AS chrom, CASE WHEN strand_a = '+' THEN x ELSE x + 30 END AS p, row_number() OVER () AS rid FROM c2), h AS (SELECT rid, min((f.chrom, fs, fe)) AS b FROM five JOIN f ON f.chrom = five.chrom AND p >= fs AND p < fe GROUP BY rid)"


@plan(_FRAGMENTS + ' SELECT b[1] AS chrom, b[2] AS start, b[3] AS "end", count(*) AS n FROM h GROUP BY ALL')
def read_fragments(spark, d):
    rows = raw(spark, d).selectExpr("chrom_a AS chrom", "x AS start", "x + 30 AS end", "strand_a AS strand")
    fragments = tables.regions(spark, d).selectExpr("chrom", "start - start % 500 AS start", "start - start % 500 + 500 AS end", "'' AS name").distinct()
    return reads.fragments_of(rows, fragments).groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT count(*)::BIGINT AS total, count(DISTINCT (chrom_a, x // 50, x // 50 + 1)) AS \"unique\", count(DISTINCT x // 50) FILTER (chrom_a = 'chr1') AS cis FROM c2")
def read_redundancy(spark, d):
    rows = raw(spark, d).selectExpr("chrom_a AS chrom", "x div 50 AS start", "x div 50 + 1 AS end")
    return reads.read_counts(rows, "chr1")


@plan("SELECT ca AS chrom_a, CASE WHEN sa = '+' THEN pa ELSE pa - 50 END AS start_a, CASE WHEN sa = '+' THEN pa + 50 ELSE pa END AS end_a, cb AS chrom_b, CASE WHEN sb = '+' THEN pb ELSE pb - 50 END AS start_b, CASE WHEN sb = '+' THEN pb + 50 ELSE pb END AS end_b, 'r' AS name, '.' AS score, sa AS strand_a, sb AS strand_b FROM raw")
def convert_valid_pairs(spark, d):
    return formats.valid_pairs_to_bedpe(tables.pets_raw(spark, d).drop("start_a", "end_a", "start_b", "end_b").withColumn("name", F.lit("r")))


@plan("SELECT ca AS chrom_a, greatest(0, pa - 50) AS start_a, pa + 50 AS end_a, cb AS chrom_b, greatest(0, pb - 50) AS start_b, pb + 50 AS end_b, '.' AS name, '.' AS score, sa AS strand_a, sb AS strand_b FROM raw")
def convert_juicer(spark, d):
    return formats.juicer_long_to_bedpe(tables.pets_raw(spark, d).drop("start_a", "end_a", "start_b", "end_b"))


@plan("SELECT ca AS chrom_a, CASE WHEN sa = '+' THEN pa ELSE greatest(0, pa) END AS start_a, CASE WHEN sa = '+' THEN pa + 40 ELSE greatest(0, pa - 110) END AS end_a, ca AS chrom_b, CASE WHEN sa = '+' THEN pa + 150 ELSE pa END AS start_b, CASE WHEN sa = '+' THEN pa + 190 ELSE pa + 40 END AS end_b, '.' AS name, '44' AS score, '+' AS strand_a, '-' AS strand_b FROM raw")
def convert_bed(spark, d):
    return formats.bed_to_bedpe(tables.pets_raw(spark, d).selectExpr("chrom_a AS chrom", "pos_a AS start", "pos_a + 40 AS end", "strand_a AS strand"))


@plan("SELECT DISTINCT ca AS chrom_a, pa // 100 AS start_a, cb AS chrom_b, pb // 100 AS start_b FROM raw WHERE (ca = cb AND abs(pb // 100 - pa // 100) >= 100) OR mapq >= 30")
def linker_unique(spark, d):
    rows = tables.pets_raw(spark, d).selectExpr("chrom_a", "pos_a div 100 AS start_a", "pos_a div 100 AS end_a", "chrom_b", "pos_b div 100 AS start_b", "pos_b div 100 AS end_b", "if(mapq >= 30, '1_5_-1', '1_-1_-1') AS name")
    return formats.linker_bedpe(rows, 100).select("chrom_a", "start_a", "chrom_b", "start_b")
