"""Domains: segregation scores along the diagonal, runs of positive scores, merging, quantification, borders of compartments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactloom.operators import intervals, selection

#: Places whose scores one task computes.
CHUNK = 256


def _window_scores(cells: pd.DataFrame, first: int, last: int, width: int) -> np.ndarray:
    """Mean of the positive correlations between the two halves of the ``width`` bins from each place on."""
    size = last - first + width
    band = np.zeros((size, size))
    np.add.at(band, (cells["bx"].to_numpy() - first, cells["by"].to_numpy() - first), cells["n"].to_numpy())
    band = np.log2(band + band.T + 1)
    out = np.zeros(last - first + 1)
    half = width // 2
    with np.errstate(all="ignore"):
        for i in range(len(out)):
            block = np.nan_to_num(np.corrcoef(band[i : i + width, i : i + width]))[half + 1 :, :half]
            out[i] = np.maximum(block, 0).mean() if block.size else 0.0
    return out


def segregation(pets: DataFrame, size: int = 20_000, window: int = 500_000) -> DataFrame:
    """key, i, start, end and ss: how far the bins before and after each place are apart, as a z-score by key.

    Bins count from the least coordinate; a place looks at ``window`` to both sides
    and has one only where they fit. Cells further from the diagonal than a window
    are never shipped, and places are scored in chunks.
    """
    cis = pets.where("dist IS NOT NULL").select("key", "x", "y")
    span = cis.groupBy("key").agg(F.min("x").alias("o"), F.max("y").alias("m"))
    span = span.select("key", "o", F.floor((F.col("m") - F.col("o") - 2 * window) / size).alias("places")).where("places > 0")
    width = 2 * window // size + 1
    at = cis.join(F.broadcast(span), "key")  # one row a key
    cells = at.groupBy("key", "places", F.floor((F.col("x") - F.col("o")) / size).alias("bx"), F.floor((F.col("y") - F.col("o")) / size).alias("by")).agg(F.count(F.lit(1)).alias("n"))
    near = cells.where(F.col("by") - F.col("bx") < width)
    # the places whose window holds both bins, and the chunks of these
    lo, hi = F.greatest(F.lit(0), F.col("by") - width + 1), F.least(F.col("bx"), F.col("places") - 1)
    chunks = F.sequence(F.floor(lo / CHUNK), F.floor(hi / CHUNK))
    dealt = near.where(lo <= hi).select("key", F.explode(chunks).alias("chunk"), "places", "bx", "by", "n")
    # chunks without cells have scores too
    blank = span.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("places") - 1) / CHUNK))).alias("chunk"), "places", *[F.lit(None).cast("long").alias(c) for c in ("bx", "by", "n")])

    def scores(d: pd.DataFrame) -> pd.DataFrame:
        chunk, places = int(d["chunk"].iloc[0]), int(d["places"].iloc[0])
        first, last = chunk * CHUNK, min((chunk + 1) * CHUNK, places) - 1
        held = d[d["n"].notna()].astype({"bx": int, "by": int})
        held = held[(held["bx"] >= first) & (held["by"] < last + width)]
        return pd.DataFrame({"key": d["key"].iloc[0], "i": np.arange(first, last + 1), "score": _window_scores(held, first, last, width)})

    found = dealt.unionByName(blank).groupBy("key", "chunk").applyInPandas(scores, "key string, i long, score double").checkpoint()
    about = found.groupBy("key").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    start = F.col("o") + window + F.col("i") * size
    z = F.coalesce(F.try_divide(F.col("score") - F.col("mean"), F.nullif("sd", F.lit(0.0))), F.lit(0.0))
    return found.join(F.broadcast(about), "key").join(F.broadcast(span), "key").select("key", "i", start.alias("start"), (start + size).alias("end"), z.alias("ss"))


def islands(scores: DataFrame, size: int, cut: float = 0.0, least: int = 10) -> DataFrame:
    """Runs of two neighbouring places at least with ss above ``cut``, longer than ``least`` bins: chrom, start, end, length, ss (their mean)."""
    high = scores.where(F.col("ss") > cut)
    runs = intervals.stitch(high.select(F.col("key").alias("chrom"), F.col("i").alias("start"), F.col("i").alias("end")), 1).select("chrom", F.col("start").alias("first"), F.col("end").alias("last"))
    runs = runs.checkpoint()
    held = intervals.hits(high.select(F.col("key").alias("chrom"), "i", "ss", F.col("start").alias("s"), F.col("end").alias("e")), "i", runs.select("chrom", F.col("first").alias("start"), F.col("last").alias("end")))
    out = held.groupBy("chrom", "start").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.avg("ss").alias("ss"), F.count(F.lit(1)).alias("places"))
    out = out.where((F.col("places") >= 2) & (F.col("e") - F.col("s") > least * size))
    return out.select(F.expr("substring(chrom, 1, (length(chrom) - 1) div 2)").alias("chrom"), F.col("s").alias("start"), F.col("e").alias("end"), (F.col("e") - F.col("s")).alias("length"), "ss")


def tested(pets: DataFrame, domains: DataFrame, total, strict: bool = False, least: int = 1_000, empty: float | None = 100.0) -> DataFrame:
    """The domains (chrom, start, end, length, ...) with pairs inside and across, their ratio es (``empty`` where none is across), density and significant.

    A domain is significant with ``least`` pairs inside, no more across, and as
    many a base as the chromosome has (twice as many, if strict).
    """
    points = intervals.points(pets)
    id = F.format_string("%s:%d-%d", "chrom", "start", "end")
    rows = domains.withColumn("domain_id", id)
    mean = points.groupBy("chrom").agg((F.count(F.lit(1)) / F.nullif(F.max("y") - F.min("x"), F.lit(0))).alias("_mean"))
    seen = intervals.window_counts(points, rows.select("domain_id", "chrom", "start", "end").distinct(), "domain_id")
    rows = rows.join(seen, "domain_id", "left").fillna(0, ["any_end", "both_ends"]).join(F.broadcast(mean), "chrom", "left")
    inside, across = F.col("both_ends"), F.col("any_end") - F.col("both_ends")
    fits = (inside >= least) & (inside >= across) & (inside / F.col("length") >= F.col("_mean") * (2 if strict else 1))
    return rows.select(
        *domains.columns, "domain_id", F.col("any_end").alias("total_pets"), inside.alias("within_pets"), F.coalesce(F.try_divide(inside.cast("double"), across), F.lit(empty)).alias("es"),
        (inside / F.col("length") / total * 1e9).alias("density"), F.coalesce(fits, F.lit(False)).alias("significant"),
    )


def call(pets: DataFrame, sizes: tuple[int, ...] = (10_000,), windows: tuple[int, ...] = (500_000,), strict: bool = False) -> DataFrame:
    """Domains of all bin sizes (ascending) and windows, merged and tested."""
    found = None
    for rank, (size, window) in enumerate((s, w) for s in sorted(sizes) for w in windows):
        one = islands(segregation(pets, size, window), size).select("*", F.lit(size).alias("bin_size"), F.lit(window).alias("win_size"), F.lit(rank).alias("rank"))
        found = one if found is None else found.unionByName(one)
    return tested(pets, selection.merged_domains(found.checkpoint()).drop("rank"), pets.count(), strict)


def mean_scores(scores: DataFrame, domains: DataFrame, size: int, window: int) -> DataFrame:
    """domain_id and the mean ss of the places from its start to before its end."""
    first = scores.groupBy("key").agg(F.min("start").alias("_o"), F.max("i").alias("_last"))
    at = domains.withColumn("key", F.concat_ws("-", "chrom", "chrom")).join(F.broadcast(first), "key")

    def place(c: Column) -> Column:
        return F.greatest(F.lit(0), F.floor((c - F.col("_o")) / size)).cast("long")

    spans = at.select("domain_id", F.col("key").alias("chrom"), place(F.col("start")).alias("start"), (place(F.col("end")) - 1).alias("end"))
    held = intervals.hits(scores.select(F.col("key").alias("chrom"), "i", "ss"), "i", spans)
    return held.groupBy("domain_id").agg(F.avg("ss").alias("ss"))


def compartments(signal: DataFrame) -> DataFrame:
    """Runs of neighbouring bins (chrom, start, end, value) of one sign: chrom, start, end, compartment (A above zero), value (their mean).

    The order is by start; a zero is a run of its own, as it has no sign.
    """
    # neighbours by rank: a run is where sign and rank keep step, found with tiles and not with one window a chromosome
    rows = signal.select("chrom", "start", "end", "value", F.floor(F.col("start") / intervals.TILE).alias("tile"), F.signum("value").cast("int").alias("sign"))
    order = Window.partitionBy("chrom", "tile").orderBy("start")
    ends = rows.groupBy("chrom", "tile").agg(F.max_by("sign", "start").alias("last"))
    before = ends.select("chrom", "tile", F.last("last").over(Window.partitionBy("chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)).alias("_last"))
    former = F.coalesce(F.lag("sign").over(order), F.col("_last"))
    opened = rows.join(before, ["chrom", "tile"]).withColumn("former", former)
    opened = opened.withColumn("opens", F.when(F.col("former").isNull() | (F.col("sign") == 0) | (F.col("sign") != F.col("former")), F.col("start"))).drop("former", "_last")
    runs = opened.groupBy("chrom", "tile").agg(F.max("opens").alias("last")).select("chrom", "tile", F.max("last").over(Window.partitionBy("chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    run = F.coalesce(F.max("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("carry"))
    named = opened.join(runs, ["chrom", "tile"]).withColumn("run", run)
    out = named.groupBy("chrom", F.col("run").alias("start")).agg(F.max("end").alias("end"), F.max("sign").alias("sign"), F.avg("value").alias("value"))
    return out.select("chrom", "start", "end", F.when(F.col("sign") > 0, "A").otherwise("B").alias("compartment"), "value")
