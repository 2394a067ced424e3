"""Two signals made comparable: noise from shifted regions, a scale from it, a line between shared peaks, a mixture that parts signal from noise.

Signals are (chrom, start, end half-open, value), peaks (chrom, start, end).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators import estimates, intervals, profiles


def shared_regions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stitched positions that both sets cover: chrom, start, end."""
    runs = [intervals.stitch(d.select("chrom", "start", "end"), 1).withColumn("region_id", F.struct("start", "end")) for d in (a, b)]
    met = intervals.overlaps(runs[0], runs[1], same=False)
    both = met.select("chrom", F.greatest("id_a.start", "id_b.start").alias("start"), F.least("id_a.end", "id_b.end").alias("end"))
    return intervals.stitch(both, 1).select("chrom", "start", "end")


def shifted_regions(a: DataFrame, b: DataFrame, ext: int = 10) -> DataFrame:
    """Background: every stitched region of either set, moved ``ext`` of its lengths down and then up, where it meets no region and
    stays within the extent of both sets. A region whose first copy is ruled out has no second one."""
    every = a.select("chrom", "start", "end").unionByName(b.select("chrom", "start", "end"))
    limits = every.groupBy("chrom").agg(F.min("start").alias("low"), F.max("end").alias("high"))  # one row a chromosome
    runs = intervals.stitch(every, 1).select("chrom", "start", "end")
    far = ext * (F.col("end") - F.col("start"))
    copies = F.explode(F.array(*[F.struct((F.col("start") + s * far).alias("s"), (F.col("end") + s * far).alias("e"), F.lit(s).alias("side")) for s in (-1, 1)]))
    moved = runs.select("chrom", F.col("start").alias("of"), copies.alias("c")).select("chrom", "of", F.col("c.s").alias("start"), F.col("c.e").alias("end"), "c.side")
    inside = moved.join(F.broadcast(limits), "chrom").where("start >= low AND end <= high").drop("low", "high").withColumn("region_id", F.struct("of", "side", "start", "end"))
    met = intervals.overlaps(inside, runs.withColumn("region_id", F.struct("start", "end")), same=False).select("chrom", F.col("id_a").alias("region_id")).distinct()
    free = inside.join(met, ["chrom", "region_id"], "left_anti")
    first = free.where("side = -1").select("chrom", "of")
    return free.where("side = -1").unionByName(free.where("side = 1").join(first, ["chrom", "of"], "left_semi")).select("chrom", "start", "end")


def _regions(d: DataFrame) -> DataFrame:
    return d.select("chrom", "start", "end").withColumn("region_id", F.format_string("%s:%d-%d", "chrom", "start", "end"))


def binned(signal: DataFrame, regions: DataFrame, bins: int) -> DataFrame:
    """region_id, bin, value for every bin of every region with ``bins`` bases at least, zeros with them."""
    r = _regions(regions).where(F.col("end") - F.col("start") >= bins)
    every = r.select("region_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(profiles.signal_profiles(signal, r, bins), ["region_id", "bin"], "left").fillna(0.0, ["value"])


def mean_signal(signal: DataFrame, regions: DataFrame, bins: int = 100) -> DataFrame:
    """bin and the mean over regions."""
    return binned(signal, regions, bins).groupBy("bin").agg(F.avg("value").alias("value"))


def noise(signal: DataFrame, background: DataFrame, bins: int = 100) -> float:
    return float(binned(signal, background, bins).agg(F.avg("value")).first()[0] or 0.0)


def signal_to_noise(signal: DataFrame, peaks: DataFrame, background: DataFrame, bins: int = 100) -> DataFrame:
    """bin, peak, background and their ratio."""
    both = mean_signal(signal, peaks, bins).withColumnRenamed("value", "peak").join(mean_signal(signal, background, bins).withColumnRenamed("value", "background"), "bin")
    return both.withColumn("ratio", F.try_divide("peak", "background"))


def fitted_line(a: DataFrame, b: DataFrame, shared: DataFrame, noise_a: float, noise_b: float, scale: float, bins: int = 2) -> tuple[float, float]:
    """Slope and offset from log2 of b to log2 of a over halves of shared peaks: equal spread and mean of what is above noise in both."""
    x = binned(a, shared, bins).select("region_id", "bin", (F.col("value") - noise_a).alias("a"))
    y = binned(b, shared, bins).select("region_id", "bin", ((F.col("value") - noise_b) * scale).alias("b"))
    both = x.join(y, ["region_id", "bin"]).where("a > 0 AND b > 0").select(F.log2("a").alias("a"), F.log2("b").alias("b"))
    sa, sb, ma, mb = both.agg(F.stddev_samp("a"), F.stddev_samp("b"), F.avg("a"), F.avg("b")).first()
    slope = sa / sb if sa and sb else 1.0
    return slope, (ma or 0.0) - slope * (mb or 0.0)


def corrected(value: Column, noise: float | None = None, scale: float | None = None, line: tuple[float, float] | None = None, trim: bool = False) -> Column:
    """Without noise, cut at zero if ``trim``, scaled, and on the line in log2 (0 where nothing is left)."""
    out = value if noise is None else value - noise
    out = F.greatest(out, F.lit(0.0)) if trim else out
    out = out if scale is None else out * scale
    return out if line is None else F.when(out > 0, F.pow(F.lit(2.0), F.log2(out) * line[0] + line[1])).otherwise(0.0)


@dataclass(frozen=True)
class Mixture:
    """Two Gaussians over log2 values: signal first."""

    means: tuple[float, float]
    variances: tuple[float, float]
    weights: tuple[float, float]

    def is_signal(self, value: Column) -> Column:
        x = F.log2(value)
        log = [math.log(w) - 0.5 * math.log(s) - (x - m) * (x - m) / (2 * s) for m, s, w in zip(self.means, self.variances, self.weights, strict=True)]
        return log[0] >= log[1]


def mixture(signal: DataFrame, peaks: DataFrame, background: DataFrame, ext: int = 5_000, bins: int = 5) -> Mixture:
    """Fitted to log2 of the signal ``ext`` around the middles of peaks, from the means in peaks and in the background on."""
    def logs(regions: DataFrame) -> DataFrame:
        return binned(signal, regions, bins).where("value > 0").select(F.log2("value").alias("v"), "region_id", "bin")

    mid = F.floor((F.col("start") + F.col("end")) / 2)
    around = peaks.select("chrom", (mid - ext).alias("start"), (mid + ext).alias("end"))
    start = [logs(d).agg(F.avg("v")).first()[0] for d in (peaks, background)]
    v = estimates._drawn(logs(around), "v", "region_id", "bin")["v"].to_numpy()
    if None in start or not len(v):
        return Mixture((1.0, 0.0), (1.0, 1.0), (0.5, 0.5))
    m, s, w, _ = estimates.gaussian_mixture(v, means=(start[0], start[1]))
    order = np.argsort(-m)
    return Mixture(*[tuple(float(x) for x in p[order]) for p in (m, s, w)])


def normalised(signal: DataFrame, parts: Mixture, noise: float, scale: float = 1.0, line: tuple[float, float] | None = None) -> DataFrame:
    """The intervals of the signal class, without noise, scaled and on the line, to five places; what falls below zero goes."""
    kept = signal.where(F.col("value") > 0).where(parts.is_signal(F.col("value"))).where(F.col("value") >= noise)
    return kept.withColumn("value", F.round(corrected(F.col("value"), noise, scale, line), 5))


def normalise(a: DataFrame, b: DataFrame, peaks_a: DataFrame, peaks_b: DataFrame, ext: int = 10) -> tuple[DataFrame, DataFrame]:
    """The reference ``a`` without noise, and ``b`` brought to its scale."""
    shared, back = shared_regions(peaks_a, peaks_b).checkpoint(), shifted_regions(peaks_a, peaks_b, ext).checkpoint()
    noise_a, noise_b = noise(a, back), noise(b, back)
    scale = noise_a / noise_b if noise_b else 1.0
    line = fitted_line(a, b, shared, noise_a, noise_b, scale)
    return normalised(a, mixture(a, peaks_a, back), noise_a), normalised(b, mixture(b, peaks_b, back), noise_b, scale, line)
