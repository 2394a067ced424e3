"""Density clusters of points (key, x, y) under city-block distance, on tables of grid cells.

``grid_clusters`` clusters cells: a cell is linked to a neighbour if their centres,
or any of their points, are within ``eps``; it is core if it and its linked
neighbours hold ``min_pts`` points. ``exact_clusters`` clusters points: a point is
core if ``min_pts`` points are within ``eps``.

Whether two neighbouring cells hold points within ``eps`` of each other is never
asked of all pairs. In one kind of direction the least distance is a difference of
extremes; in the other two differences must both be small, which a sweep answers:
points in order of one, with the running least of the other. So work grows with
points, however many share a cell. Equal points are one row with a count.

Clusters are named by their start: of the core cells, the one with the most points
(ties: the smaller cell). A border cell goes to the latest cluster whose start cell
links to it, or else to the first one that links to it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactloom.operators.network import components
from contactloom.session import prepare

_HALF = ((1, 0), (0, 1), (1, 1), (1, -1))
_AROUND = tuple((dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy)


def counted(points: DataFrame) -> DataFrame:
    """key, x, y and c, how often the point occurs."""
    return points.groupBy("key", "x", "y").agg(F.count(F.lit(1)).alias("c"))


def _celled(points: DataFrame, width: int, u: Column, v: Column) -> DataFrame:
    """Points with their cell, counted from the least coordinates of their key."""
    rows = points.withColumns({"u": u, "v": v})
    low = rows.groupBy("key").agg(F.min("u").alias("_u"), F.min("v").alias("_v"))  # one row a key
    cell = {c: F.floor((F.col(a) - F.col(f"_{a}")) / width) for c, a in (("cx", "u"), ("cy", "v"))}
    return rows.join(F.broadcast(low), "key").withColumns(cell).drop("_u", "_v")


def _neighbours(cells: DataFrame, offsets: tuple, *keep: str) -> DataFrame:
    """key, cx, cy of each cell and nx, ny of the cells that exist at the offsets, with their columns ``keep``."""
    at = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("nx"), (F.col("cy") + dy).alias("ny")) for dx, dy in offsets]))
    asked = cells.select("key", "cx", "cy", at.alias("a")).select("key", "cx", "cy", "a.*")
    return asked.join(cells.select("key", F.col("cx").alias("nx"), F.col("cy").alias("ny"), *keep), ["key", "nx", "ny"])


#: Cells on a side of a tile, and cells that a Python worker takes at a time.
TILE, CELLS = 256, 100_000


def _tile_of(c: str) -> Column:
    """The tiles that must know a cell: its own, and a neighbour if it is within two cells of it."""
    own, at = F.floor(F.col(c) / TILE), F.pmod(F.col(c), F.lit(TILE))
    return F.when(at < 2, F.array(own, own - 1)).when(at >= TILE - 2, F.array(own, own + 1)).otherwise(F.array(own))


def _held(min_pts: int) -> Callable[[pa.Table], pa.Table]:
    """Of cells by tile, the ones of the tile itself that are not sparse or have a neighbour that is not."""
    width = TILE + 6

    def held(cells: pa.Table) -> pa.Table:
        code = cells["key"].combine_chunks().dictionary_encode()
        cx, cy, tx, ty, n = (cells[c].to_numpy() for c in ("cx", "cy", "tx", "ty", "n"))
        tile = pd.DataFrame({"k": code.indices.to_numpy(), "x": tx, "y": ty}).groupby(["k", "x", "y"], sort=False).ngroup().to_numpy()
        # the tile with a margin of two cells, and an empty one around that
        place = (tile * width + cx - tx * TILE + 3) * width + cy - ty * TILE + 3
        order = np.argsort(place)
        known = place[order]

        def around(values: np.ndarray) -> np.ndarray:
            own, out = values[order], values.copy()
            for dx, dy in _AROUND:
                want = place + dx * width + dy
                at = np.minimum(np.searchsorted(known, want), len(known) - 1)
                out += np.where(known[at] == want, own[at], 0)
            return out

        kept = around((around(n) >= min_pts).astype(np.int64)) > 0
        return cells.select(["key", "cx", "cy"]).filter(pa.array(kept & (cx // TILE == tx) & (cy // TILE == ty)))

    return held


def without_noise(cells: DataFrame, min_pts: int) -> DataFrame:
    """The cells (key, cx, cy) of ``cells`` (key, cx, cy, n; once each, read twice) without sparse ones among sparse ones: a cell is sparse if its nine hold fewer than ``min_pts``.

    Cells go by tiles with a margin, so that a cell moves once and no neighbours are joined.
    """
    buckets = cells.count() // CELLS + 1
    rows = cells.select("key", "cx", "cy", F.col("n").cast("long").alias("n"), F.explode(_tile_of("cx")).alias("tx"))
    rows = rows.select("*", F.explode(_tile_of("cy")).alias("ty"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "tx", "ty"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(_held(min_pts), "key string, cx long, cy long")


def denoised(pets: DataFrame, eps: int = 1_000, min_pts: int = 5) -> DataFrame:
    """Cis pairs (key, x, y) outside noise cells of ``eps``."""
    rows = _celled(pets.where("dist IS NOT NULL").select("key", "x", "y"), eps, F.col("x"), F.col("y"))
    cells = rows.groupBy("key", "cx", "cy").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    return rows.join(without_noise(cells, min_pts), ["key", "cx", "cy"], "left_semi").select("key", "x", "y")


def _within(pairs: DataFrame, points: DataFrame, eps: int, p: Column, q: Column) -> DataFrame:
    """The cell pairs (key, cx, cy, nx, ny) with a point b of the second cell and a point a of the first one with p(b) - p(a) <= eps and q(b) - q(a) <= eps."""
    pts = points.select("key", F.col("cx").alias("ox"), F.col("cy").alias("oy"), p.alias("p"), q.alias("q"))
    names = ["key", "cx", "cy", "nx", "ny"]
    a = pairs.join(pts.withColumnsRenamed({"ox": "cx", "oy": "cy"}), ["key", "cx", "cy"]).select(*names, (F.col("p") + eps).alias("p"), (F.col("q") + eps).alias("q"), F.lit(1).alias("asks"))
    b = pairs.join(pts.withColumnsRenamed({"ox": "nx", "oy": "ny"}), ["key", "nx", "ny"]).select(*names, "p", "q", F.lit(0).alias("asks"))
    order = Window.partitionBy(*names).orderBy("p", "asks").rowsBetween(Window.unboundedPreceding, 0)
    low = F.min(F.when(F.col("asks") == 0, F.col("q"))).over(order)
    return a.unionByName(b).withColumn("low", low).where("asks = 1 AND low <= q").select(*names).distinct()


def _both_ways(links: DataFrame) -> DataFrame:
    back = links.select("key", F.col("nx").alias("cx"), F.col("ny").alias("cy"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    return links.select("key", "cx", "cy", "nx", "ny").unionByName(back)


def _cell_links(cells: DataFrame, points: DataFrame, eps: int) -> DataFrame:
    """Links of cells with centres or points within ``eps``, both ways."""
    stats = ["mx", "my", "min_x", "max_x", "min_y", "max_y", "min_s", "max_s", "min_d", "max_d"]
    near = _neighbours(cells, _HALF, *[F.col(c).alias(f"n_{c}") for c in stats]).join(cells.select("key", "cx", "cy", *stats), ["key", "cx", "cy"])
    centres = F.abs(F.col("mx") - F.col("n_mx")) + F.abs(F.col("my") - F.col("n_my")) <= eps
    dx, dy = F.col("nx") - F.col("cx"), F.col("ny") - F.col("cy")
    # towards a corner the distance is a difference of sums or of differences
    corner = F.when(dy == 1, F.col("n_min_s") - F.col("max_s") <= eps).otherwise(F.col("n_min_d") - F.col("max_d") <= eps)
    hopeless = F.when(dx == 1, F.col("n_min_x") - F.col("max_x") > eps).otherwise(F.col("n_min_y") - F.col("max_y") > eps)
    state = F.when(centres, 1).when((dx == 1) & (dy != 0), corner.cast("int")).when(hopeless, 0)
    near = near.select("key", "cx", "cy", "nx", "ny", state.alias("state")).checkpoint()
    open_ = near.where("state IS NULL").drop("state")
    s, d = F.col("x") + F.col("y"), F.col("x") - F.col("y")
    found = near.where("state = 1").drop("state")
    for pairs, q in ((open_.where("nx > cx"), d), (open_.where("nx = cx"), -d)):
        found = found.unionByName(_within(pairs, points, eps, s, q))
    return _both_ways(found)


def _node(x: str = "cx", y: str = "cy") -> Column:
    return F.struct("key", F.col(x).alias("cx"), F.col(y).alias("cy"))


def _named(cores: DataFrame, links: DataFrame) -> DataFrame:
    """The core cells (key, cx, cy, n) with the start of their component, as (rank, cx, cy): smaller for larger starts."""
    both = links.join(cores.select("key", "cx", "cy"), ["key", "cx", "cy"], "left_semi")
    both = both.join(cores.select("key", F.col("cx").alias("nx"), F.col("cy").alias("ny")), ["key", "nx", "ny"], "left_semi")
    parts = components(both.select(_node().alias("a"), _node("nx", "ny").alias("b")))
    rows = cores.withColumn("node", _node()).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    start = F.struct((-F.col("n")).alias("rank"), "cx", "cy")
    starts = rows.groupBy("component").agg(F.min(start).alias("start"))
    return rows.join(starts, "component").select("key", "cx", "cy", "start")


def grid_clusters(points: DataFrame, eps: int, min_pts: int) -> DataFrame:
    """key, x, y, c and ``start`` (the name of its cluster within the key) of the points in clusters."""
    prepare(points.sparkSession)
    rows = _celled(counted(points), eps, F.col("x"), F.col("y")).drop("u", "v").checkpoint()
    # noise goes before anything else is asked of points
    kept = without_noise(rows.groupBy("key", "cx", "cy").agg(F.sum("c").alias("n")).checkpoint(), min_pts)
    rows = rows.join(kept, ["key", "cx", "cy"], "left_semi").checkpoint()
    x, y, c = F.col("x"), F.col("y"), F.col("c")
    cells = rows.groupBy("key", "cx", "cy").agg(
        F.sum("c").alias("n"), (F.sum(x * c) / F.sum("c")).alias("mx"), (F.sum(y * c) / F.sum("c")).alias("my"),
        F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"),
        F.min(x + y).alias("min_s"), F.max(x + y).alias("max_s"), F.min(x - y).alias("min_d"), F.max(x - y).alias("max_d"),
    ).checkpoint()
    links = _cell_links(cells, rows, eps).checkpoint()
    sizes = cells.select("key", "cx", "cy", "n")
    near = links.join(sizes.withColumnsRenamed({"cx": "nx", "cy": "ny"}), ["key", "nx", "ny"]).groupBy("key", "cx", "cy").agg(F.sum("n").alias("near"))
    cores = sizes.join(near, ["key", "cx", "cy"], "left").where(F.col("n") + F.coalesce("near", F.lit(0)) >= min_pts).drop("near").checkpoint()
    named = _named(cores, links).checkpoint()
    of = named.select("key", F.col("cx").alias("nx"), F.col("cy").alias("ny"), "start")
    is_start = (F.col("nx") == F.col("start.cx")) & (F.col("ny") == F.col("start.cy"))
    border = links.join(of, ["key", "nx", "ny"]).join(named.select("key", "cx", "cy"), ["key", "cx", "cy"], "left_anti")
    border = border.groupBy("key", "cx", "cy").agg(F.min("start").alias("first"), F.max(F.when(is_start, F.col("start"))).alias("last"))
    border = border.select("key", "cx", "cy", F.greatest("first", "last").alias("start"))
    return rows.join(named.unionByName(border), ["key", "cx", "cy"]).select("key", "x", "y", "c", "start")


def exact_clusters(points: DataFrame, eps: int, min_pts: int) -> DataFrame:
    """key, x, y, c and ``start`` of the points in clusters of points within ``eps`` of core points; clusters below ``min_pts`` are let go.

    On axes turned by 45 degrees the neighbourhood is a square, so all points of a
    cell are neighbours: in a cell of ``min_pts`` points all are core, and only the
    few points of other cells look around. A border point goes to the first cluster.
    """
    prepare(points.sparkSession)
    rows = _celled(counted(points), eps, F.col("x") - F.col("y"), F.col("x") + F.col("y")).checkpoint()
    cells = rows.groupBy("key", "cx", "cy").agg(F.sum("c").alias("n")).checkpoint()
    full = rows.join(cells.where(F.col("n") >= min_pts).drop("n"), ["key", "cx", "cy"], "left_semi")
    few = rows.join(cells.where(F.col("n") < min_pts).drop("n"), ["key", "cx", "cy"], "left_semi")

    def around(asking: DataFrame, known: DataFrame, *keep) -> DataFrame:
        at = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
        asked = asking.select("key", "x", "y", "u", "v", at.alias("a")).select("key", "x", "y", "u", "v", "a.*")
        met = asked.join(known.select("key", "cx", "cy", F.col("u").alias("pu"), F.col("v").alias("pv"), *keep), ["key", "cx", "cy"])
        return met.where((F.abs(F.col("u") - F.col("pu")) <= eps) & (F.abs(F.col("v") - F.col("pv")) <= eps))

    busy = around(few, rows, "c").groupBy("key", "x", "y").agg(F.sum("c").alias("near")).where(F.col("near") >= min_pts).select("key", "x", "y")
    core = full.unionByName(few.join(busy, ["key", "x", "y"], "left_semi")).checkpoint()
    edges = core.groupBy("key", "cx", "cy").agg(F.sum("c").alias("n"), *[f(a).alias(f"{k}_{a}") for a in "uv" for k, f in (("min", F.min), ("max", F.max))]).checkpoint()
    stats = ["min_u", "max_u", "min_v", "max_v"]
    near = _neighbours(edges, _HALF, *[F.col(c).alias(f"n_{c}") for c in stats]).join(edges.select("key", "cx", "cy", *stats), ["key", "cx", "cy"])
    flat_u, flat_v = F.col("n_min_u") - F.col("max_u") <= eps, F.col("n_min_v") - F.col("max_v") <= eps
    straight = near.where((F.col("ny") == F.col("cy")) & flat_u | (F.col("nx") == F.col("cx")) & flat_v).select("key", "cx", "cy", "nx", "ny")
    up = near.where("nx > cx AND ny > cy").select("key", "cx", "cy", "nx", "ny")
    down = near.where("nx > cx AND ny < cy").select("key", "cx", "cy", "nx", "ny")
    links = straight.unionByName(_within(up, core, eps, F.col("u"), F.col("v"))).unionByName(_within(down, core, eps, F.col("u"), -F.col("v")))
    # points of one cell are neighbours, so a cell's core points are in one cluster
    named = _named(edges.select("key", "cx", "cy", "n"), _both_ways(links)).checkpoint()
    inner = core.join(named, ["key", "cx", "cy"])
    rest = few.join(core.select("key", "x", "y"), ["key", "x", "y"], "left_anti")
    border = around(rest, inner, "start").groupBy("key", "x", "y").agg(F.min("start").alias("start"))
    out = inner.select("key", "x", "y", "c", "start").unionByName(rest.join(border, ["key", "x", "y"]).select("key", "x", "y", "c", "start")).checkpoint()
    large = out.groupBy("key", "start").agg(F.sum("c").alias("n")).where(F.col("n") >= min_pts).drop("n")
    return out.join(large, ["key", "start"], "left_semi").select("key", "x", "y", "c", "start")


def boxes(clusters: DataFrame) -> DataFrame:
    """The box of every cluster wide in both directions: key, start_a, end_a (x), start_b, end_b (y), points."""
    out = clusters.groupBy("key", "start").agg(
        F.min("x").alias("start_a"), F.max("x").alias("end_a"), F.min("y").alias("start_b"), F.max("y").alias("end_b"), F.sum("c").alias("points")
    )
    return out.where("start_a < end_a AND start_b < end_b").drop("start")
