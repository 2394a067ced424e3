"""Loops that differ between two samples: united loops, counts and backgrounds in both, a line between them, cutoffs, tests, marks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import tails
from contactloom.operators import intervals, selection, tiles
from contactloom.operators import loops as lp

TILES = 4


def counted(target: DataFrame, control: DataFrame, loops: DataFrame) -> DataFrame:
    """``loops`` with ra, rb, rab, background (the four moved pairs of anchors, by place) and their mean, es, each for t (target) and c (control)."""
    for name, pets in (("t", target), ("c", control)):
        points, loops = intervals.points(pets), loops.checkpoint()
        seen = lp.counted(points, loops.select("loop_id", "chrom", *lp.BOX)).select("loop_id", *[F.col(k).alias(f"{k}_{name}") for k in ("ra", "rb", "rab")])
        cells = tiles.counts(points, loops, tiles.shifted, 1, False).groupBy("loop_id")
        by_place = [F.coalesce(F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("n"))), F.lit(0)) for i in (-1, 1) for j in (-1, 1)]
        back = cells.agg(F.array(*by_place).alias(f"tiles_{name}"))
        loops = loops.join(seen, "loop_id").join(back, "loop_id", "left").withColumn(f"tiles_{name}", F.coalesce(f"tiles_{name}", F.array(*[F.lit(0).cast("long")] * TILES)))
        mean = F.aggregate(f"tiles_{name}", F.lit(0.0), lambda a, v: a + v) / TILES
        loops = loops.withColumn(f"around_{name}", mean).withColumn(f"es_{name}", F.col(f"rab_{name}") / F.greatest(F.col(f"around_{name}"), F.lit(1.0)))
    return loops


def fitted_line(counts: DataFrame) -> tuple[float, float]:
    """Slope and offset that take the log2 background of the target to that of the control: equal spread and mean."""
    both = _backgrounds(counts)
    m = both.agg(F.stddev_pop("c"), F.stddev_pop("t"), F.avg("c"), F.avg("t")).first()
    slope = m[0] / m[1] if m[1] else 1.0
    return slope, (m[2] or 0.0) - slope * (m[3] or 0.0)


def _backgrounds(counts: DataFrame, pseudo: float = 1.0) -> DataFrame:
    each = counts.select(F.explode(F.arrays_zip("tiles_t", "tiles_c")).alias("e"))
    return each.select(F.log2(F.col("e.tiles_t") + pseudo).alias("t"), F.log2(F.col("e.tiles_c") + pseudo).alias("c"))


def cutoffs(counts: DataFrame, line: tuple[float, float], fdr: float = 0.05, step: float = 0.1, most: int = 1_000) -> tuple[float, float]:
    """(a, m): the first limits, raised in turn by ``step``, that at most ``fdr`` of the background exceeds with both its mean and its difference.

    The background comes to the driver as a histogram over steps: its size is the
    square of the range of logarithms, whatever the number of loops.
    """
    scaled = F.lit(line[0]) * F.col("t") + F.lit(line[1])
    at = _backgrounds(counts).select(*[F.floor(v / step + 1e-6).alias(k) for k, v in (("m", F.abs(F.col("c") - scaled)), ("a", (F.col("c") + scaled) / 2))])
    cells = at.groupBy("m", "a").agg(F.count(F.lit(1)).alias("n")).toPandas()
    total, a, m = cells["n"].sum(), 0, 0
    for i in range(most):
        a, m = (a + 1, m) if i % 2 == 0 else (a, m + 1)
        if not total or cells.loc[(cells["m"] >= m) & (cells["a"] >= a), "n"].sum() / total <= fdr:
            break
    return a * step, m * step


def _log2(c: Column) -> Column:
    """Minus infinity at zero."""
    return F.when(c <= 0, float("-inf")).otherwise(F.log2(c))


def tested(counts: DataFrame, line: tuple[float, float], total_t: int, total_c: int, pseudo: float = 1.0) -> DataFrame:
    """Adds densities, counts of the target scaled by the line, p and both fold changes (log2; infinite where one side is empty)."""
    size = F.expr("end_a - start_a + end_b - start_b")

    def scaled(c: str) -> Column:
        return F.when(F.col(c) <= 0, 0.0 if line[0] > 0 else None).otherwise(F.pow(F.lit(2.0), F.lit(line[0]) * F.log2(F.col(c)) + F.lit(line[1])))

    rows = counts.withColumns({f"scaled_{k}": scaled(f"{k}_t") for k in ("ra", "rb", "rab", "around")})
    rows = rows.withColumns({f"density_{s}": F.greatest(F.col(f"rab_{s}"), F.lit(pseudo)) / size / total * 1e9 for s, total in (("t", total_t), ("c", total_c))})
    up = F.col("scaled_rab") > F.col("rab_c")
    front = F.when(up, F.col("scaled_rab")).otherwise(F.col("rab_c"))
    back = F.when(up, F.greatest("rab_c", "around_c")).otherwise(F.greatest("scaled_rab", "scaled_around"))
    return rows.withColumns({
        "p": tails.poisson_sf(front.cast("double"), back.cast("double")), "raw_fc": _log2(F.col("rab_t") / total_t) - _log2(F.col("rab_c") / total_c),
        "scaled_fc": _log2(F.col("scaled_rab")) - _log2(F.col("rab_c")),
    })


def marked(rows: DataFrame, acut: float, mcut: float, pcut: float = 0.01, ignore_p: bool = False, raw_p: bool = False, pseudo: float = 1.0) -> DataFrame:
    """Adds significant: p (Bonferroni, unless ``raw_p``) within ``pcut`` (unless ``ignore_p``), fold change and mean beyond their limits."""
    if not raw_p:
        n = rows.agg(F.count(F.lit(1)).cast("double").alias("_n"))  # one row
        rows = rows.join(F.broadcast(n)).withColumn("p", tails.bonferroni(F.col("p"), F.col("_n"))).drop("_n")
    mean = (F.log2(F.greatest(F.col("rab_c"), F.lit(pseudo))) + F.log2(F.greatest(F.col("scaled_rab"), F.lit(pseudo)))) / 2
    fits = (F.abs("scaled_fc") >= mcut) & (mean >= acut)
    return rows.withColumn("significant", (fits if ignore_p else fits & (F.col("p") <= pcut)).cast("int"))


def call(target: DataFrame, control: DataFrame, loops_t: DataFrame, loops_c: DataFrame, name_t: str = "target", name_c: str = "control", fdr: float = 0.1, pcut: float = 0.01, limits: tuple[float, float] | None = None, ignore_p: bool = False, raw_p: bool = False) -> DataFrame:
    """All loops of both samples with counts, tests and marks; ``limits`` (a, m) replaces the estimated ones."""
    loops = selection.united_loops(loops_t, loops_c, name_t, name_c).checkpoint()
    counts = counted(target, control, loops).checkpoint()
    line = fitted_line(counts)
    acut, mcut = limits or cutoffs(counts, line, fdr)
    return marked(tested(counts, line, target.count(), control.count()), acut, mcut, pcut, ignore_p, raw_p)


def mean_tiles(counts: DataFrame, reach: int = 5, norm: bool = True) -> tuple[pd.DataFrame, DataFrame]:
    """The mean matrix of loops (loop_id, i, j, n), each as z-scores if ``norm``, and loop_id with es, its centre over the mean of the others."""
    n = (2 * reach + 1) ** 2
    stats = counts.groupBy("loop_id").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.coalesce(F.sum(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("n"))), F.lit(0)).alias("mid"))
    es = stats.where("s > mid OR s = 0").select("loop_id", F.coalesce(F.try_divide(F.col("mid") * F.lit(float(n)), F.col("s") - F.col("mid")), F.lit(0.0)).alias("es"))
    loops = stats.agg(F.count(F.lit(1)).alias("l"), F.sum(F.col("s") / n / F.sqrt(F.greatest(F.col("q") / n - F.pow(F.col("s") / n, 2), F.lit(1e-12)))).alias("zero"))
    sd = F.sqrt(F.greatest(F.col("q") / n - F.pow(F.col("s") / n, 2), F.lit(1e-12)))
    value = F.col("n") / sd if norm else F.col("n").cast("double")
    sums = counts.join(stats, "loop_id").groupBy("i", "j").agg(F.sum(value).alias("v")).toPandas()  # (2 * reach + 1) ** 2 rows
    total = loops.first()
    out = pd.DataFrame(0.0, index=range(-reach, reach + 1), columns=range(-reach, reach + 1))
    for r in sums.itertuples():
        out.loc[r.i, r.j] = r.v
    if total["l"]:
        out = (out - (total["zero"] if norm else 0.0)) / total["l"]
    return out, es
