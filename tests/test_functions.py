import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np

from contactloom.functions import tails
from contactloom.operators import intervals, network, pets
from contactloom.sources import formats


def test_tails_against_sums():
    k, mu = np.array([1, 5, 3, 40, 900, 100]), np.array([1.0, 2.5, 10.0, 30.0, 1000.0, 1e-3])
    with localcontext() as c:
        c.prec = 60
        want = [max(tails.FLOOR, float(1 - (-Decimal(m)).exp() * sum(Decimal(m) ** i / math.factorial(i) for i in range(a)))) for a, m in zip(k.tolist(), mu.tolist())]
    assert np.allclose(tails.poisson_tail(k, mu), want, rtol=1e-8, atol=0)
    for k, n, p in ((1, 10, 0.1), (5, 10, 0.5), (2, 30, 0.3), (30, 30, 0.01), (700, 2000, 0.2)):
        q = Fraction(p).limit_denominator(100)
        want = float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1)))
        assert np.allclose(tails.binomial_tail(k, n, p), max(want, tails.FLOOR), rtol=1e-8, atol=0)
    for k, total, marked, drawn in ((1, 50, 5, 10), (4, 50, 5, 10), (30, 200, 60, 80), (2, 10, 8, 6), (20, 5000, 40, 300)):
        want = sum(Fraction(math.comb(marked, i) * math.comb(total - marked, drawn - i), math.comb(total, drawn)) for i in range(k, min(marked, drawn) + 1))
        assert np.allclose(tails.hypergeometric_tail(k, total, marked, drawn), float(want), rtol=1e-8, atol=0)
    assert np.allclose(tails.chi_square_tail([0.0, 6.6348966010212145, 3.841458820694124]), [1, 0.01, 0.05])
    assert tails.poisson_tail([0, 2, 5000, np.nan], [3, 0, 1e-3, 1]).tolist()[:3] == [1, tails.FLOOR, tails.FLOOR] and np.isnan(tails.poisson_tail(np.nan, 1.0)[0])
    assert tails.binomial_tail([0, 3, 3, 2], [5, 2, 3, 4], [0.5, 0.5, 1.0, 0.0]).tolist() == [1, tails.FLOOR, 1, tails.FLOOR]
    assert np.allclose(tails.log_gamma([0.5, 1, 2, 10.5, 1e6]), [math.lgamma(v) for v in (0.5, 1, 2, 10.5, 1e6)], rtol=1e-12, atol=1e-12)


def test_canonical_orders_both_kinds(spark):
    raw = spark.createDataFrame(
        [("chr1", 150, "chr1", 15, 30, "+", "-", "a"), ("chr2", 5, "chr10", 55, 30, "+", "-", "a")],
        "chrom_a string, pos_a long, chrom_b string, pos_b long, mapq int, strand_a string, strand_b string, library string",
    )
    rows = {r.key: (r.x, r.y, r.strand_a, r.dist) for r in pets.canonical(raw).collect()}
    assert rows == {"chr1-chr1": (15, 150, "-", 135), "chr10-chr2": (55, 5, "-", None)}


def test_stitch_joins_neighbours(spark):
    r = spark.createDataFrame([(1, "c", 1, 3), (2, "c", 4, 6), (3, "c", 8, 9)], "region_id long, chrom string, start long, end long")
    assert sorted(tuple(x) for x in intervals.stitch(r, 1).collect()) == [("c", 1, 6, 2), ("c", 8, 9, 1)]


def test_components_of_a_chain_and_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 9), (9, 7)], "a long, b long")
    assert dict(map(tuple, network.components(e).collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


def test_bedpe_and_pairs(spark, tmp_path):
    (tmp_path / "a.bedpe").write_text("chr1\t100\t200\tchr1\t10\t20\tn\t.\t+\t-\nchr1\tx\t2\tchr1\t1\t2\tn\t9\t+\t-\n")
    assert [tuple(r) for r in formats.read_bedpe(spark, str(tmp_path / "a.bedpe")).collect()] == [("chr1", 150, "chr1", 15, 255, "+", "-")]
    (tmp_path / "a.pairs").write_text("# head\nr\tchr1\t5\tchr1\t9\t+\t-\tUU\nr\tchr1\t5\tchr1\t9\t+\t-\tNN\nr\tchr1\t5\tchr1\t9\t+\t-\n")
    assert formats.read_pairs(spark, str(tmp_path / "a.pairs")).count() == 2
