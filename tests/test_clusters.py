"""Clusters, selection, scores and networks against plain versions."""

import numpy as np
import pytest

from contactloom.operators import annotate, cluster, differential, domains, estimates, intervals, selection, tiles
from contactloom.operators import loops as lp
from contactloom.operators import peaks as pk


def _points(seed, n, spread):
    r = np.random.default_rng(seed)
    centres = r.integers(0, spread, (4, 2))
    dense = (centres[r.integers(0, 4, n // 2)] + r.normal(0, 15, (n // 2, 2))).astype(int)
    return [tuple(map(int, p)) for p in np.r_[dense, r.integers(0, spread, (n - n // 2, 2))]]


def _visit(points, eps, least):
    """Cells in order of visits: sparse ones among sparse ones go; a start takes all it is linked to, later cells only what is free."""
    low = [min(p[k] for p in points) for k in (0, 1)]
    cells = {}
    for p in points:
        cells.setdefault(tuple((p[k] - low[k]) // eps for k in (0, 1)), []).append(p)

    def around(c):
        return [(c[0] + i, c[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (c[0] + i, c[1] + j) in cells]

    sparse = {c for c in cells if len(cells[c]) + sum(len(cells[q]) for q in around(c)) < least}
    for c in [c for c in sparse if set(around(c)) <= sparse]:
        sparse.discard(c)
        cells[c] = None
    cells = {c: v for c, v in cells.items() if v}
    mean = {c: [sum(p[k] for p in v) / len(v) for k in (0, 1)] for c, v in cells.items()}

    def linked(c):
        near = []
        for q in around(c):
            far = sum(abs(a - b) for a, b in zip(mean[c], mean[q]))
            if far <= eps or any(abs(a[0] - b[0]) + abs(a[1] - b[1]) <= eps for a in cells[c] for b in cells[q]):
                near.append(q)
        return near

    label, number = {}, 0
    for c in sorted(cells, key=lambda c: (-len(cells[c]), c)):
        if c in label:
            continue
        near = linked(c)
        if len(cells[c]) + sum(len(cells[q]) for q in near) < least:
            label[c] = None
            continue
        todo = [c, *near]
        label |= dict.fromkeys(todo, number)
        while todo:
            q = todo.pop(0)
            more = linked(q)
            if len(cells[q]) + sum(len(cells[z]) for z in more) >= least:
                for z in more:
                    if label.get(z) is None:
                        label[z] = number
                        todo.append(z)
        number += 1
    out = {}
    for c, k in label.items():
        if k is not None:
            out.setdefault(k, set()).update(cells[c])
    return {frozenset(v) for v in out.values()}


def _groups(rows, name="start"):
    out = {}
    for r in rows:
        out.setdefault((r.key, r[name]), set()).add((r.x, r.y))
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("seed,eps,least", [(1, 40, 5), (2, 60, 8), (3, 25, 4)])
def test_grid_clusters_as_visited(spark, seed, eps, least):
    points = _points(seed, 400, 900)
    rows = spark.createDataFrame([("k", *p) for p in points], "key string, x long, y long")
    assert _groups(cluster.grid_clusters(rows, eps, least).collect()) == _visit(points, eps, least)


def _dbscan(points, eps, least):
    near = {p: [q for q in set(points) if abs(p[0] - q[0]) + abs(p[1] - q[1]) <= eps] for p in set(points)}
    often = {p: points.count(p) for p in near}
    core = {p for p in near if sum(often[q] for q in near[p]) >= least}
    out, seen = [], set()
    for p in core:
        if p not in seen:
            part, todo = {p}, [p]
            while todo:
                for q in near[todo.pop()]:
                    if q in core and q not in part:
                        part.add(q)
                        todo.append(q)
            seen |= part
            out.append(part)
    return near, core, out


def test_exact_clusters_against_all_pairs(spark):
    points = _points(5, 300, 600)
    near, core, parts = _dbscan(points, 30, 5)
    rows = cluster.exact_clusters(spark.createDataFrame([("k", *p) for p in points], "key string, x long, y long"), 30, 5).collect()
    found = _groups(rows)
    assert {frozenset(g & core) for g in found} == {frozenset(p) for p in parts}
    where = {p: g for g in found for p in g}
    border = {p for p in near if p not in core and any(q in core for q in near[p])}
    assert set(where) == core | border and all(any(q in core and q in where[p] for q in near[p]) for p in border)


def test_empty_and_single_points(spark):
    none = spark.createDataFrame([], "key string, x long, y long")
    one = spark.createDataFrame([("k", 5, 9)], "key string, x long, y long")
    for of in (cluster.grid_clusters, cluster.exact_clusters):
        assert of(none, 10, 2).count() == 0 and of(one, 10, 2).count() == 0 and of(one, 10, 1).count() == 1


def test_selection_of_loops_peaks_domains():
    boxes = np.array([[0, 10, 100, 110], [5, 15, 105, 115], [12, 20, 112, 120], [40, 50, 140, 150]])
    # the first takes the second, and that one the third: one stays of the chain, and what it does not meet comes back
    assert selection.strongest(boxes, np.array([1.0, 5.0, 2.0, 1.0])).tolist() == [1, 3]
    assert sorted(selection.strongest(boxes, np.array([9.0, 5.0, 2.0, 1.0])).tolist()) == [0, 2, 3]
    assert selection.shortest(np.array([[0, 10], [5, 20], [18, 40]])).tolist() == [0, 2]


def test_selection_in_tables(spark):
    rows = spark.createDataFrame([(f"l{i}", "c", i * 100, i * 100 + 50, 5000, 5050, float(i % 3)) for i in range(20)] + [("m", "c", 10, 40, 5010, 5040, 9.0)], "loop_id string, chrom string, start_a long, end_a long, start_b long, end_b long, es double")
    assert {r.loop_id for r in selection.best_loops(rows).collect()} == {"m", *[f"l{i}" for i in range(1, 20)]}
    doms = spark.createDataFrame([("c", 0, 1000, 1.0, 0), ("c", 0, 990, 2.0, 1), ("c", 2000, 2500, 0.5, 1), ("c", 2000, 2490, 0.4, 2)], "chrom string, start long, end long, ss double, rank int")
    assert sorted((r.start, r.end) for r in selection.merged_domains(doms).collect()) == [(0, 990), (2000, 2500)]
    a = spark.createDataFrame([("1", "c", 0, 10, 100, 110), ("2", "c", 300, 310, 400, 410)], "loop_id string, chrom string, start_a long, end_a long, start_b long, end_b long")
    b = spark.createDataFrame([("7", "c", 5, 20, 90, 105), ("8", "c", 6, 12, 101, 120), ("9", "d", 1, 2, 3, 4)], a.schema)
    assert {tuple(r) for r in selection.united_loops(a, b, "A", "B").collect()} == {("1|A|7|B", "c", 0, 20, 90, 110), ("2|A", "c", 300, 310, 400, 410), ("8|B", "c", 6, 12, 101, 120), ("9|B", "d", 1, 2, 3, 4)}


def test_stitching_over_tiles_and_ties(spark):
    r = np.random.default_rng(0)
    spans = [(int(s), int(s + w)) for s, w in zip(r.integers(0, 400_000, 300), r.integers(0, 3000, 300))]
    spans += spans[:40] + [(10, 300_000)]
    rows = spark.createDataFrame([("c", *s) for s in spans], "chrom string, start long, end long")
    want = []
    for s, e in sorted(spans):
        if want and s <= want[-1][1] + 5:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert sorted((x.start, x.end) for x in intervals.stitch(rows, 5).collect()) == sorted(map(tuple, want))


def test_segregation_against_dense_matrix(spark):
    r = np.random.default_rng(4)
    x = r.integers(0, 60_000, 4000)
    y = np.minimum(x + r.integers(0, 8_000, 4000), 60_000)
    size, window = 500, 3_000
    rows = spark.createDataFrame([("c-c", int(a), int(b), int(b - a)) for a, b in zip(x, y)], "key string, x long, y long, dist long")
    o, m = int(x.min()), int(y.max())
    mat = np.zeros(((m - o) // size + 1,) * 2)
    np.add.at(mat, ((x - o) // size, (y - o) // size), 1)
    mat = mat + mat.T
    places, wide, want = (m - o - 2 * window) // size, 2 * window // size + 1, []
    for i in range(places):
        with np.errstate(all="ignore"):
            c = np.nan_to_num(np.corrcoef(np.log2(mat[i : i + wide, i : i + wide] + 1)))
        want.append(np.maximum(c[wide // 2 + 1 :, : wide // 2], 0).mean())
    want = (np.array(want) - np.mean(want)) / np.std(want)
    got = {q.i: q for q in domains.segregation(rows, size, window).collect()}
    assert len(got) == places and np.allclose([got[i].ss for i in range(places)], want) and got[0].start == o + window


def test_calls_find_planted_structure(spark):
    r = np.random.default_rng(6)
    rows = []
    for a, b in ((50_000, 150_000), (260_000, 420_000)):
        rows += [(int(a + p), int(b + q)) for p, q in r.integers(0, 800, (60, 2))]
        for at in (a, b):  # anchors have close pairs too
            rows += [(int(at + p), int(at + p + q)) for p, q in zip(r.integers(0, 700, 150), r.integers(30, 250, 150))]
    # the test of the common pairs needs a chromosome that holds many more
    rows += [tuple(sorted(map(int, p))) for p in r.integers(0, 500_000, (6000, 2))]
    pets = spark.createDataFrame([("c-c", "c", "c", x, y, y - x) for x, y in rows], "key string, chrom_a string, chrom_b string, x long, y long, dist long").distinct().checkpoint()
    got = lp.call_cis(pets, (500,), (10,)).collect()
    assert sorted((round(x.start_a, -4), round(x.start_b, -4)) for x in got) == [(50_000, 150_000), (260_000, 420_000)]
    assert all(x.fdr <= 0.05 and x.es >= 2 and x.significant == 1 for x in got)
    peaks = pk.call(pets.where("dist <= 1000"), (100,), (5,)).collect()
    assert {round(p.start, -4) for p in peaks} == {50_000, 150_000, 260_000, 420_000} and all(max(p.pvalues) <= 0.01 and p.start <= p.summit <= p.end for p in peaks)


def test_trans_calls_find_planted_structure(spark):
    r = np.random.default_rng(7)
    rows = [(int(300_000 + p), int(700_000 + q)) for p, q in r.integers(0, 900, (80, 2))] + [tuple(map(int, p)) for p in r.integers(0, 1_000_000, (300, 2))]
    pets = spark.createDataFrame([("c-d", "c", "d", x, y) for x, y in rows], "key string, chrom_a string, chrom_b string, x long, y long").selectExpr("*", "CAST(NULL AS long) AS dist").distinct()
    got = lp.call_trans(pets, (600,), (8,)).collect()
    assert [(round(x.start_a, -4), round(x.start_b, -4), x.significant) for x in got] == [(300_000, 700_000, 1)]


def test_differential_marks(spark):
    r = np.random.default_rng(9)
    known = [(f"l{i}", "c", 100_000 * i, 100_000 * i + 800, 100_000 * i + 40_000, 100_000 * i + 40_800) for i in range(1, 41)]

    def sample(counts):
        rows = [(int(a + p), int(c + q)) for (_, _, a, _, c, _), n in zip(known, counts) for p, q in r.integers(0, 800, (n, 2))]
        rows += [tuple(sorted(map(int, p))) for p in r.integers(0, 4_200_000, (3000, 2))]
        return spark.createDataFrame([("c-c", "c", "c", x, y, y - x) for x, y in rows], "key string, chrom_a string, chrom_b string, x long, y long, dist long").distinct().checkpoint()

    loops = spark.createDataFrame(known, "loop_id string, chrom string, start_a long, end_a long, start_b long, end_b long")
    got = {x.loop_id.split("|")[0]: x for x in differential.call(sample([40] * 39 + [400]), sample([40] * 38 + [400, 40]), loops, loops).collect()}
    # moved anchors touch the loop too, so limits rise until fewer than a tenth of the loops differ
    assert len(got) == 40 and {k for k, x in got.items() if x.significant} == {"l39", "l40"}
    assert got["l40"].scaled_fc > 1 and got["l39"].scaled_fc < -1 and 30 <= got["l1"].rab_t <= 45


def test_tiles_median_and_mean(spark):
    row = spark.createDataFrame([([1, 2, 3],), ([],), ([5] * 100,), (list(range(1, 61)),)], "v array<bigint>")
    got = [tuple(x) for x in row.select(tiles.padded_median(row.v, 100), tiles.padded_mean(row.v, 100)).collect()]
    want = [np.r_[np.zeros(100 - len(v)), np.sort(v)] for v in ([1, 2, 3], [], [5] * 100, range(1, 61))]
    assert got == [(float(np.median(w)), float(np.mean(w))) for w in want]


def test_networks(spark):
    names = {n: f"c:{i * 100}-{i * 100 + 50}|{'Promoter' if n[0] == 'P' else 'Enhancer'}" for i, n in enumerate(("P1", "E1", "E2", "P2", "E3"))}
    edges = spark.createDataFrame([(names[a], names[b]) for a, b in (("P1", "E1"), ("E1", "E2"), ("E2", "P2"), ("P1", "E3"))], "a string, b string")
    got = {r.promoter: r for r in annotate.promoter_targets(edges).collect()}
    one = got[names["P1"]]
    assert (one.direct_enhancers, one.indirect_enhancers, one.indirect_promoters) == (sorted([names["E1"], names["E3"]]), [names["E2"]], [names["P2"]])
    assert one.direct_hub == names["E1"] and one.indirect_hub == ""
    nodes = sorted(names.values())
    m = np.zeros((5, 5))
    for a, b in edges.collect():
        m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = 1
    h = np.ones(5)
    for _ in range(2000):
        h = m @ (m @ h)
        h /= h.sum()
    hub = {r.node: r.hub for r in annotate.hub_scores(edges).collect()}
    assert np.allclose([hub[n] for n in nodes], h, atol=1e-4)
    region = spark.createDataFrame([("r", "c", 420, 430), ("none", "c", 60, 90), ("edge", "c", 50, 51)], "region_id string, chrom string, start long, end long")
    genes = spark.createDataFrame([(names["P1"], "G1"), (names["P2"], "G2")], "anchor string, genes string")
    targets, paths = annotate.region_targets(edges, genes, region)
    assert {(r.region_id, tuple(r.direct_genes), tuple(r.indirect_genes)) for r in targets.collect()} == {("r", ("G1",), ("G2",)), ("edge", ("G1",), ("G2",))}
    assert [r.path for r in paths.where("region_id = 'r'").collect()] == [[names[n] for n in ("E3", "P1", "E1", "E2", "P2")]]


def test_estimates():
    r = np.random.default_rng(1)
    v = np.r_[r.normal(8, 1, 3000), r.normal(15, 2, 5000)]
    m, s, w, _ = estimates.gaussian_mixture(v)
    assert np.allclose(np.sort(m), [8, 15], atol=0.2) and np.allclose(np.sort(w), [3 / 8, 5 / 8], atol=0.03)
    at = estimates.crossing(1.0, 1.0, 6.0, 2.0)
    assert abs(np.exp(-((at - 1) ** 2) / 2) - np.exp(-((at - 6) ** 2) / 8) / 2) < 1e-9
    at, value = estimates.knee(np.r_[np.linspace(1, 2, 900), np.linspace(8, 9, 100)])
    assert 780 <= at <= 900 and value <= 8
    x = np.linspace(0, 10, 60)
    assert np.abs(estimates.lowess(x, 3 * x + 1) - (3 * x + 1)).max() < 1e-6
    assert estimates.ligation_cut(2 ** r.normal(15, 1, 4000), 2 ** r.normal(8, 1, 4000)) < 2**14


def test_scaling_factor(spark):
    rows = spark.createDataFrame([(float(c), 2.5 * c) for c in range(1, 200)] + [(5.0, 900.0)], "c double, t double")
    assert abs(estimates.scaling_factor(rows, "t", "c") - 2.5) < 0.1


def test_every_pair_of_cells_that_is_close(spark):
    # straight and corner neighbours whose centres are apart but whose points are not
    for a, b in (((9, 5), (10, 5)), ((5, 9), (5, 10)), ((9, 9), (10, 10)), ((9, 10), (10, 9))):
        points = [a, b, (0, 0), (19, 19)] + [(a[0] // 10 * 10, a[1] // 10 * 10)] * 6 + [(b[0] // 10 * 10 + 9, b[1] // 10 * 10 + 9)] * 6
        rows = spark.createDataFrame([("k", *p) for p in points], "key string, x long, y long")
        assert _groups(cluster.grid_clusters(rows, 10, 3).collect()) == _visit(points, 10, 3), (a, b)
