"""Wide keys, and cells and distances in tiles, against plain versions."""

import numpy as np
import pytest

from contactloom.operators import annotate, cluster, estimates, matrix


def test_components_of_wide_keys(spark):
    rng = np.random.default_rng(1)
    place = np.sort(rng.choice(3 * matrix.DENSE, 80, replace=False))
    place[0], place[-1] = 0, 3 * matrix.DENSE
    made, mats = {}, []
    for name in "ab":
        i = np.sort(rng.zipf(1.6, (3_000, 2)) % 80, axis=1)
        i = np.vstack([i, [[0, 79]]])
        rows = [("k", int(place[u]) * 10, int(place[v]) * 10 + 7 + n % 3) for n, (u, v) in enumerate(i)]
        made[name] = spark.createDataFrame(rows, "key string, x long, y long").selectExpr("*", "y - x AS dist")
        m = np.zeros((80, 80))
        np.add.at(m, (i[:, 0], i[:, 1]), 1)
        mats.append(m + m.T)
    # what the empty bins between the places do to the centred mean is in its width alone
    width = int(place[-1]) + 1
    mean = sum(mats) / 2
    centre = mean.sum(axis=0) / width
    axes = np.linalg.eigh(mean @ mean - width * np.outer(centre, centre))[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    flat = [np.r_[(m @ axes - centre @ axes), np.tile(-centre @ axes, (width - 80, 1))].ravel() for m in mats]
    got = estimates.principal_similarity(made, 10)
    assert got.loc["a", "b"] == pytest.approx(np.corrcoef(*flat)[0, 1], abs=1e-8)


def test_leading_of_close_values():
    values = np.r_[1 + 1e-4 * np.arange(60), np.linspace(0, 0.9, 400)]
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((460, 460)))[0]
    a = (q * values) @ q.T
    got = estimates.leading(lambda v: a @ v, 460, 2)
    assert np.abs(np.abs(got @ q[:, [59, 58]]) - np.eye(2)).max() < 1e-5
    assert estimates.leading(lambda v: 0 * v, 3, 2).shape == (2, 3)


def test_noise_by_tiles(spark):
    rng = np.random.default_rng(3)
    at = rng.integers(0, 3 * cluster.TILE, (60, 2))
    at = np.unique(np.vstack([rng.integers(0, 3 * cluster.TILE, (4_000, 2)), np.repeat(at, 12, axis=0) + rng.integers(-2, 3, (720, 2)), [[cluster.TILE - 1 + i, cluster.TILE + j] for i in range(3) for j in range(-2, 2)]]), axis=0)
    at = at[(at >= 0).all(axis=1)]
    n = {k: {(int(x), int(y)): int(c) for (x, y), c in zip(at, rng.integers(1, 3, len(at)), strict=True) if k == "a" or (x + y) % 3} for k in "ab"}
    rows = spark.createDataFrame([(k, *c, v) for k in "ab" for c, v in n[k].items()], "key string, cx long, cy long, n long")
    nine = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    full = {(k, x, y) for k in "ab" for x, y in n[k] if sum(n[k].get((x + i, y + j), 0) for i, j in nine) >= 6}
    want = {(k, x, y) for k in "ab" for x, y in n[k] if any((k, x + i, y + j) in full for i, j in nine)}
    kept = cluster.without_noise(rows, 6)
    got = [(r.key, r.cx, r.cy) for r in kept.collect()]
    assert 100 < len(want) < len(rows.collect()) and set(got) == want and len(got) == len(want)
    # a cell moves once: neighbours are not joined
    plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_cells_of_neighbours_do_not_fill(spark):
    # blocks far apart on the diagonal: the extent says little about the density
    rows = spark.range(20_000).selectExpr("'k' AS key", "(id % 40) * 100000000 + id * 7919 % 30011 AS x", "(id % 40) * 100000000 + 40000 + id * 104729 % 30013 AS y").selectExpr("*", "1L AS c")
    reach = estimates._crowded(rows, 1_000_000)
    cells = rows.selectExpr(f"x div {reach} AS u", f"y div {reach} AS v").groupBy("u", "v").count().toPandas()["count"]
    assert 64 < reach < 10_000 and (cells**2).sum() / cells.sum() <= estimates.CROWD


def test_pair_classes_keep_single_rows(spark):
    rows = spark.range(3_000).selectExpr("concat('c', id % 2) AS chrom_a", "concat('c', id % 3 % 2) AS chrom_b", "id * 7919 % 40000 AS x", "id * 104729 % 40000 AS y")
    e = [(f"c{i % 2}", i * 611, i * 611 + 20 + i % 300) for i in range(60)] + [("c1", 16_000, 33_500), ("c0", 9, 9)]
    p = [(f"c{i % 2}", i * 977 + 100, i * 977 + 180) for i in range(40)]
    e_df, p_df = (spark.createDataFrame(k, "chrom string, start long, end long") for k in (e, p))

    def touches(known, chrom, at):
        return any(c == chrom and s < f and at - 50 < f and at + 50 > s for c, s, f in known)

    want = {}
    for r in rows.collect():
        ae, ap, be, bp = (touches(k, c, v) for c, v in ((r.chrom_a, r.x), (r.chrom_b, r.y)) for k in (e, p))
        kind = ("Enhancer-Promoter" if (ae and bp) or (ap and be) else "Enhancer-Enhancer" if ae and be else "Promoter-Promoter" if ap and bp
                else "Enhancer-Other" if ae or be else "Promoter-Other" if ap or bp else "Other-Other")
        want[kind] = want.get(kind, 0) + 1
    got = annotate.pair_classes(rows, e_df, p_df)
    assert {r.kind: r.n for r in got.collect()} == want
    # pairs are neither written, nor numbered, nor grouped: only their kinds are
    tops = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Range (" in line]
    assert len(tops) == 1
