"""Contact matrices in sparse form and scores along the diagonal.

Sliding windows are counted by differences: a pair lies in a run of neighbouring
windows, so it adds one at the first and takes one away after the last, whatever
the number of windows, and running sums over tiles give the counts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactloom.operators import intervals


def _offsets(pets: DataFrame) -> DataFrame:
    """Cis pairs with o, the least coordinate of their key (one row a key, so the join is by broadcast)."""
    cis = pets.where("dist IS NOT NULL")
    return cis.join(F.broadcast(cis.groupBy("key").agg(F.min("x").alias("o"))), "key")


def _cell(size, at: str) -> Column:
    return F.floor((F.col(at) - F.col("o")) / size)


def bins(pets: DataFrame, size: int) -> DataFrame:
    """Pairs in each cell: key, bin_x, bin_y, n. Bins start at the least coordinate of the key."""
    return _offsets(pets).groupBy("key", _cell(size, "x").alias("bin_x"), _cell(size, "y").alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def symmetric(cells: DataFrame) -> DataFrame:
    """Both triangles; the diagonal counts twice, as sums of a matrix and its transpose do."""
    sides = F.explode(F.array(F.struct("bin_x", "bin_y"), F.struct(F.col("bin_y").alias("bin_x"), F.col("bin_x").alias("bin_y"))))
    return cells.select("key", sides.alias("s"), "n").groupBy("key", "s.bin_x", "s.bin_y").agg(F.sum("n").alias("n"))


def without_singletons(pets: DataFrame, size: int) -> DataFrame:
    """Pairs that do not have their cell to themselves: key, x, y.

    A cell of one pair is told by its sum: the pairs of others are found by a semi join on the cell.
    """
    at = _offsets(pets).select("key", "x", "y", _cell(size, "x").alias("bx"), _cell(size, "y").alias("by"))
    kept = at.groupBy("key", "bx", "by").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return at.join(kept, ["key", "bx", "by"], "left_semi").select("key", "x", "y")


def resolution(pets: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """For each bin size: cells off the diagonal, and the shares of cells and pairs that are singletons. One pass for all sizes."""
    at = _offsets(pets).select("key", "x", "y", "o", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])).alias("bin_size"))
    cells = at.groupBy("bin_size", "key", _cell(F.col("bin_size"), "x").alias("bx"), _cell(F.col("bin_size"), "y").alias("by")).agg(F.count(F.lit(1)).alias("n"))
    out = cells.where("bx <> by").groupBy("bin_size").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("pets"), F.count_if(F.col("n") == 1).alias("singletons"))
    return out.select("*", F.round(F.try_divide("singletons", "cells"), 6).alias("cell_share"), F.round(F.try_divide("singletons", "pets"), 6).alias("pet_share"))


def fingerprint(pets: DataFrame, size: int, slices: int = 100, diagonal: bool = True) -> DataFrame:
    """Share of pairs in the poorest cells, slice by slice. Cells of equal count are told apart by histogram, not by sorting."""
    cells = bins(pets, size)
    counts = (cells if diagonal else cells.where("bin_x <> bin_y")).groupBy("n").agg(F.count(F.lit(1)).alias("cells"))  # a row for each count: short
    return curve(counts, slices)


def curve(counts: DataFrame, slices: int = 100) -> DataFrame:
    """The fingerprint of a histogram (n, cells)."""
    order = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.select("n", "cells", F.sum("cells").over(order).alias("upto"), F.sum(F.col("n") * F.col("cells")).over(order).alias("mass"))
    all_cells, all_mass = F.max("upto").over(Window.partitionBy()), F.max("mass").over(Window.partitionBy())
    run = run.select("*", all_cells.alias("total"), all_mass.alias("pets"))
    at = run.withColumn("slice", F.explode(F.sequence(F.lit(1), F.lit(slices))))
    rank = F.floor(F.col("slice") * F.col("total") / slices)
    at = at.withColumn("rank", rank).where("rank > upto - cells AND rank <= upto")
    return at.select("slice", F.round((F.col("mass") - (F.col("upto") - F.col("rank")) * F.col("n")) / F.col("pets"), 6).alias("share"))


def shared_cells(samples: dict[str, DataFrame], size: int, least: int = 2) -> DataFrame:
    """Cell counts of every sample, in columns of their names, where any sample exceeds ``least``; cells start at the key's least coordinate of all samples."""
    rows = None
    for name, pets in samples.items():
        one = pets.where("dist IS NOT NULL").select("key", "x", "y", "dist", F.lit(name).alias("sample"))
        rows = one if rows is None else rows.unionByName(one)
    counted = _offsets(rows).groupBy("key", _cell(size, "x").alias("bx"), _cell(size, "y").alias("by")).pivot("sample", list(samples)).agg(F.count(F.lit(1)))
    counted = counted.fillna(0, list(samples))
    return counted.where(F.greatest(*samples, F.lit(0)) > least) if len(samples) > 1 else counted.where(F.col(next(iter(samples))) > least)


def similarity(samples: dict[str, DataFrame], size: int, least: int = 2) -> DataFrame:
    """Pearson correlation of the cell counts of every two samples: sample_a, sample_b, pcc, cells."""
    cells = shared_cells(samples, size, least)
    wanted = list(combinations(samples, 2))
    told = cells.agg(F.count(F.lit(1)).alias("cells"), *[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(wanted)])
    each = F.array(*[F.struct(F.lit(a).alias("sample_a"), F.lit(b).alias("sample_b"), F.round(F.col(f"c{i}"), 6).alias("pcc")) for i, (a, b) in enumerate(wanted)])
    return told.select(F.explode(each).alias("e"), "cells").select("e.*", "cells")


def _sliding(pets: DataFrame, size: int, margin: int, runs: dict[str, tuple[Column, Column]], by: str = "key") -> DataFrame:
    """Counts of each key's windows i at pos = start + i * size, start = least x + margin, up to the largest y - margin.

    ``runs`` gives for each name the first and last place at which a pair counts.
    """
    cis = pets.where("dist IS NOT NULL").select(F.col(by).alias("chrom"), "x", "y")
    span = cis.groupBy("chrom").agg((F.min("x") + margin).alias("s"), (F.max("y") - margin).alias("e"))
    span = span.select("chrom", "s", F.floor((F.col("e") - F.col("s")) / size).alias("bins")).where("bins > 0")
    at = cis.join(F.broadcast(span), "chrom")  # one row a chromosome
    edges = []
    for name, (first, last) in runs.items():
        lo = F.greatest(F.lit(0), F.ceil((first - F.col("s")) / size)).cast("long")
        hi = F.least(F.col("bins") - 1, F.floor((last - F.col("s")) / size)).cast("long")
        edges += [F.when(lo <= hi, F.struct(i.alias("i"), *[F.lit(step if n == name else 0).alias(n) for n in runs])) for i, step in ((lo, 1), (hi + 1, -1))]
    steps = at.select("chrom", F.explode(F.array_compact(F.array(*edges))).alias("e")).select("chrom", F.col("e.i").alias("start"), *[f"e.{n}" for n in runs])
    # every window has a row, changed or not
    blank = span.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("start"), *[F.lit(0).alias(n) for n in runs])
    steps = steps.unionByName(blank).groupBy("chrom", "start").agg(*[F.sum(n).alias(n) for n in runs])
    counted = intervals.running(steps, *runs).join(F.broadcast(span), "chrom").where("start < bins")
    return counted.select(F.col("chrom").alias("key"), (F.col("s") + F.col("start") * size).alias("pos"), *runs)


def insulation(pets: DataFrame, size: int = 10_000, step: int = 100_000) -> DataFrame:
    """Pairs across each position against those on its two sides within ``step``, and the z-score of that by key."""
    x, y = F.col("x"), F.col("y")
    c = _sliding(pets, size, step, {"whole": (y - step, x + step), "lft": (y, x + step), "rgt": (y - step, x)}).where("lft + rgt > 0")
    c = c.withColumn("score", (F.col("whole") - F.col("lft") - F.col("rgt")) / (F.col("lft") + F.col("rgt")))
    m = c.groupBy("key").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    z = F.try_divide(F.col("score") - F.col("mean"), F.nullif("sd", F.lit(0.0)))
    return c.join(F.broadcast(m), "key").select("key", "pos", (F.col("pos") + size).alias("end"), F.round("score", 6).alias("score"), F.round(z, 4).alias("z"))


def directionality(pets: DataFrame, size: int = 10_000, step: int = 100_000) -> DataFrame:
    """Pairs with both ends within ``step`` before (a) and after (b) each position, and their index."""
    x, y = F.col("x"), F.col("y")
    c = _sliding(pets, size, step, {"a": (y, x + step), "b": (y - step, x)}).where("a + b > 0")
    e = (F.col("a") + F.col("b")) / 2
    index = F.signum((F.col("b") - F.col("a")).cast("double")) * (F.pow(F.col("a") - e, 2) + F.pow(F.col("b") - e, 2)) / e
    return c.select("key", "pos", (F.col("pos") + size).alias("end"), "a", "b", F.round(index, 6).alias("di"))


def local_density(pets: DataFrame, size: int = 1_000, ext: int = 10) -> DataFrame:
    """Pairs per million that join each bin with the ``ext / 2`` bins on either side.

    A position on a border belongs to both bins. A pair counts at a bin once for
    each other bin within reach that it touches; it touches four at most.
    """
    half, margin = ext // 2, size * ext // 2
    cis = pets.where("dist IS NOT NULL").select("key", "x", "y")
    span = cis.groupBy("key").agg((F.min("x") + margin).alias("s"), (F.max("y") - margin).alias("e"), F.count(F.lit(1)).alias("total"))
    span = span.select("key", "s", "total", F.floor((F.col("e") - F.col("s")) / size).alias("bins")).where("bins > 0")

    def touched(at: str) -> Column:
        i, off = F.floor((F.col(at) - F.col("s")) / size), F.pmod(F.col(at) - F.col("s"), F.lit(size))
        return F.when(off == 0, F.array(i, i - 1)).otherwise(F.array(i))

    at = cis.join(F.broadcast(span), "key").withColumn("u", F.array_union(touched("x"), touched("y"))).where(F.size("u") > 1)
    near = F.size(F.filter("u", lambda v: (v != F.col("i")) & (F.abs(v - F.col("i")) <= half)))
    told = at.select("key", "u", F.explode("u").alias("i")).select("key", "i", near.alias("n")).groupBy("key", "i").agg(F.sum("n").alias("n"))
    blank = span.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("i"), "s", "total")
    out = blank.join(told, ["key", "i"], "left").fillna(0, ["n"])
    start = F.col("s") + F.col("i") * size
    return out.select("key", start.alias("start"), (start + size).alias("end"), F.round(F.col("n") * 1e6 / F.col("total"), 6).alias("ids"))


def window_cells(pets: DataFrame, key: str, start: int, end: int, size: int) -> DataFrame:
    """Symmetric cells (bin_x, bin_y, n) of the pairs of a key that lie within [start, end]."""
    inside = pets.where((F.col("key") == key) & (F.col("x") >= start) & (F.col("y") <= end))
    cells = inside.groupBy("key", F.floor((F.col("x") - start) / size).alias("bin_x"), F.floor((F.col("y") - start) / size).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))
    return symmetric(cells).drop("key")


def shuffled(pets: DataFrame, seed: int) -> DataFrame:
    """Cis pairs with the ends of each key dealt anew: key, x, y. The same ones for the same seed.

    Both ends are numbered in the order of a hash, in tiles of the hash, so that no
    task orders a whole key, and met by number.
    """
    cis = pets.where("dist IS NOT NULL").select("key", "x", "y")

    def dealt(end: str, salt: int) -> DataFrame:
        h = F.xxhash64(F.lit(seed), F.lit(salt), "x", "y")
        rows = cis.select("key", end, h.alias("h"), F.shiftrightunsigned(h, 48).alias("tile"))
        before = Window.partitionBy("key").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
        ahead = rows.groupBy("key", "tile").agg(F.count(F.lit(1)).alias("c")).select("key", "tile", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"))
        order = Window.partitionBy("key", "tile").orderBy("h", end)
        return rows.join(ahead, ["key", "tile"]).select("key", end, (F.col("ahead") + F.row_number().over(order)).alias("i"))

    return dealt("x", 1).join(dealt("y", 2), ["key", "i"]).select("key", "x", "y")


def _dense(cells: pd.DataFrame, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    out[cells["bin_x"].to_numpy(), cells["bin_y"].to_numpy()] = cells["n"].to_numpy()
    return out


#: Bins of a window that becomes a dense matrix: 4,000 x 4,000 numbers of 8 bytes are 128 MB.
DENSE = 4_000


def contact_matrix(pets: DataFrame, key: str, start: int, end: int, size: int, expected: int = 0, log: bool = False, corr: bool = False, norm: bool = False, seed: int = 0) -> pd.DataFrame:
    """The dense matrix of a window of at most ``DENSE`` bins, as it is drawn or written.

    With ``expected`` the counts are set against the mean of that many shuffles, on
    the pairs that keep their order; ``log`` takes logarithms to base ten of counts
    plus one, ``corr`` correlates rows, ``norm`` takes z-scores.
    """
    width = (end - start) // size + 1
    if width > DENSE:
        raise ValueError(f"{width} bins are too many for a dense matrix; take larger bins or a smaller window")
    mat = _dense(window_cells(pets, key, start, end, size).toPandas(), width)
    back = None
    if expected:
        window = pets.where((F.col("key") == key) & (F.col("x") >= start) & (F.col("y") <= end))
        back = sum(_dense(window_cells(shuffled(window, seed + i).where("x < y"), key, start, end, size).toPandas(), width) for i in range(expected)) / expected
    if log:
        mat = np.log10(mat + 1) - (0 if back is None else np.log10(back + 1))
    elif back is not None:
        mat = (mat + 1) / (back + 1)
    if corr:
        with np.errstate(all="ignore"):
            mat = np.nan_to_num(np.corrcoef(mat))
    if norm:
        mat = (mat - mat.mean()) / (mat.std() or 1.0)
    names = [f"{key.split('-')[0]}|{start + i * size}|{start + (i + 1) * size}" for i in range(width)]
    return pd.DataFrame(mat, index=names, columns=names)
