"""Genes at regions and loops, networks of anchors, targets along them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators import intervals
from contactloom.operators.network import components

#: Distance up to which the nearest start makes a promoter.
PROMOTER = 2_000
#: Bases of a tile whose runs go to a pair's end as one list.
NEAR = 1 << 14


def one_gene_per_start(genes: DataFrame) -> DataFrame:
    """The gene with the smallest id of those that share a start."""
    rest = [c for c in genes.columns if c not in ("chrom", "tss")]
    return genes.groupBy("chrom", "tss").agg(F.min(F.struct("gene_id", *[c for c in rest if c != "gene_id"])).alias("g")).select("chrom", "tss", "g.*")


def starts_of(regions: DataFrame, genes: DataFrame, pdis: int = PROMOTER) -> DataFrame:
    """region_id, kind, distance and genes (their ids, sorted) of regions (region_id, chrom, start, end).

    All starts inside count, at distance 0; without one, the start nearest to the
    middle, at the distance rounded down. Several starts, or a distance up to
    ``pdis``, make a promoter, anything else an enhancer. Without genes on the
    chromosome the region does not show.
    """
    g = one_gene_per_start(genes.select("chrom", "tss", "gene_id"))
    r = regions.select("region_id", "chrom", "start", "end")
    inside = intervals.hits(g, "tss", r).groupBy("region_id").agg(F.array_sort(F.collect_set("gene_id")).alias("genes"))
    # twice the coordinates, so that middles are whole
    spots = r.join(inside, "region_id", "left_anti").select("chrom", (F.col("start") + F.col("end")).alias("pos"), "region_id")
    near = intervals.nearest(spots, g.select("chrom", (F.col("tss") * 2).alias("pos"), F.col("gene_id").alias("target"))).where("found IS NOT NULL")
    near = near.select("region_id", F.array("found.target").alias("genes"), F.expr("found.distance div 2").alias("distance"))
    both = inside.select("region_id", "genes", F.lit(0).cast("long").alias("distance")).unionByName(near)
    kind = F.when((F.size("genes") > 1) | (F.col("distance") <= pdis), "Promoter").otherwise("Enhancer")
    return both.select("region_id", kind.alias("kind"), "distance", "genes")


def loop_genes(loops: DataFrame, genes: DataFrame, pdis: int = PROMOTER) -> DataFrame:
    """loop_id with kind, distance and genes of both anchors."""
    sides = intervals.anchors(loops).withColumn("region_id", F.struct("loop_id", "side"))
    told = starts_of(sides, genes, pdis).select("region_id.*", "kind", "distance", "genes")
    out = None
    for s in "ab":
        one = told.where(F.col("side") == s).select("loop_id", *[F.col(c).alias(f"{c}_{s}") for c in ("kind", "distance", "genes")])
        out = one if out is None else out.join(one, "loop_id")
    return out


def merged_anchors(loops: DataFrame, genes: DataFrame, pdis: int = PROMOTER, gap: int = 1) -> DataFrame:
    """Stitched anchors: anchor (chrom:start-end|kind), chrom, start, end, kind, distance, genes."""
    runs = intervals.stitch(intervals.anchors(loops), gap).withColumn("region_id", F.struct("chrom", "start", "end"))
    told = runs.join(starts_of(runs, genes, pdis), "region_id")
    return told.select(F.format_string("%s:%d-%d|%s", "chrom", "start", "end", "kind").alias("anchor"), "chrom", "start", "end", "kind", "distance", "genes")


def loop_anchors(loops: DataFrame, anchors: DataFrame) -> DataFrame:
    """loop_id with the merged anchors of both sides."""
    held = intervals.hits(intervals.anchors(loops).select("loop_id", "chrom", "side", F.col("start").alias("pos")), "pos", anchors.select("chrom", "start", "end", "anchor"))
    return held.groupBy("loop_id").agg(*[F.max(F.when(F.col("side") == s, F.col("anchor"))).alias(f"anchor_{s}") for s in "ab"]).where("anchor_a IS NOT NULL AND anchor_b IS NOT NULL")


def links(of_loops: DataFrame) -> DataFrame:
    """Edges a < b between merged anchors, once each, with their kind, such as Enhancer-Promoter."""
    e = of_loops.where("anchor_a <> anchor_b").select(F.least("anchor_a", "anchor_b").alias("a"), F.greatest("anchor_a", "anchor_b").alias("b")).distinct()
    kinds = F.array_sort(F.array(F.element_at(F.split("a", "\\|"), -1), F.element_at(F.split("b", "\\|"), -1)))
    return e.select("a", F.concat_ws("-", kinds).alias("type"), "b")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def hub_scores(edges: DataFrame, rounds: int = 1_000) -> DataFrame:
    """node and hub: the shares of the leading vector of each component's squared adjacency, by power iteration.

    A component's edges go to one task: anchors of one chromosome.
    """
    parts = components(edges.select("a", "b"))
    held = edges.select("a", "b").join(parts.withColumnRenamed("node", "a"), "a")

    def scores(d: pd.DataFrame) -> pd.DataFrame:
        nodes, code = np.unique(np.concatenate([d["a"].to_numpy(str), d["b"].to_numpy(str)]), return_inverse=True)
        a, b = np.split(code, 2)
        h = np.full(len(nodes), 1 / len(nodes))

        def through(v: np.ndarray) -> np.ndarray:
            return np.bincount(a, v[b], len(v)) + np.bincount(b, v[a], len(v))

        for _ in range(rounds):
            new = through(through(h))
            new /= new.max()
            if np.abs(new - h).sum() < 1e-8:
                break
            h = new
        return pd.DataFrame({"node": nodes, "hub": h / h.sum()})

    return held.groupBy("component").applyInPandas(scores, "node string, hub double")


def _is(column: str, kind: str):
    return F.col(column).endswith(f"|{kind}")


def promoter_targets(edges: DataFrame) -> DataFrame:
    """Every promoter with the enhancers and promoters it reaches, direct and not, and, of two enhancers or more, the one with the highest hub score.

    Lists are as long as a component: the result is what is asked for.
    """
    parts = components(edges.select("a", "b"))
    reach = parts.where(_is("node", "Promoter")).select(F.col("node").alias("promoter"), "component").join(parts, "component").where("promoter <> node")
    near = both_ways(edges).select(F.col("a").alias("promoter"), F.col("b").alias("node"), F.lit(True).alias("direct"))
    told = reach.join(near, ["promoter", "node"], "left").join(hub_scores(edges), "node").withColumn("direct", F.coalesce("direct", F.lit(False)))
    columns = []
    for kind in ("Enhancer", "Promoter"):
        for direct in (True, False):
            one = F.when(_is("node", kind) & (F.col("direct") == direct), F.col("node"))
            columns.append(F.array_sort(F.collect_set(one)).alias(("direct" if direct else "indirect") + f"_{kind.lower()}s"))
    for direct in (True, False):
        here = _is("node", "Enhancer") & (F.col("direct") == direct)
        best = F.min_by(F.when(here, F.col("node")), F.when(here, F.struct((-F.round("hub", 9)).alias("h"), "node")))
        columns.append(F.when(F.count_if(here) >= 2, best).otherwise("").alias(("direct" if direct else "indirect") + "_hub"))
    return told.groupBy("promoter").agg(*columns)


def _paths(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """source, target, path: a shortest path (of several the first by name) from every asked node to each node it reaches."""
    parts = components(edges.select("a", "b")).checkpoint()
    e = both_ways(edges).join(parts.withColumnRenamed("node", "a"), "a").select("component", "a", "b")
    q = asked.select(F.col("node").alias("source")).distinct().join(parts.withColumnRenamed("node", "source"), "source").select(F.col("component").alias("part"), "source")

    def walk(d: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        near = {a: sorted(b) for a, b in d.groupby("a")["b"]}
        out = []
        for source in sources["source"]:
            path, front = {source: [source]}, [source]
            while front:
                later = []
                for node in front:
                    for other in near.get(node, ()):
                        if other not in path:
                            path[other] = [*path[node], other]
                            later.append(other)
                front = later
            out += [(source, node, p) for node, p in path.items() if node != source]
        return pd.DataFrame(out, columns=["source", "target", "path"])

    return e.groupBy("component").cogroup(q.groupBy("part")).applyInPandas(walk, "source string, target string, path array<string>")


def anchor_of(node) -> list:
    """chrom, start, end of a node's name, as columns."""
    place = F.regexp_extract(node, r"^(.*):(\d+)-(\d+)\|", 1)
    return [place.alias("chrom"), *[F.regexp_extract(node, r"^(.*):(\d+)-(\d+)\|", i).cast("long").alias(k) for i, k in ((2, "start"), (3, "end"))]]


def region_targets(edges: DataFrame, genes_of: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, paths) of regions (region_id, chrom, start, end half-open) through the network.

    A region meets anchors. A promoter is its own direct target, and all promoters
    it reaches are indirect ones; an enhancer's neighbours are direct, others are
    not. ``genes_of`` (anchor, genes) names promoters; others are left out.
    """
    nodes = both_ways(edges).select(F.col("a").alias("node")).distinct().select("node", *anchor_of(F.col("node")))
    r = regions.where("start < end").select("chrom", "region_id", "start", (F.col("end") - 1).alias("end"))
    # the one holds the start of the other
    first = intervals.hits(nodes.select("chrom", F.col("start").alias("pos"), "node"), "pos", r).select("region_id", "node")
    second = intervals.hits(r.select("chrom", F.col("start").alias("pos"), "region_id"), "pos", nodes).select("region_id", "node")
    met = first.unionByName(second).distinct().checkpoint()
    paths = _paths(edges, met).where(_is("target", "Promoter"))
    known = genes_of.select(F.col("anchor").alias("target"), F.col("genes").alias("of"))
    steps = paths.join(known, "target").select(F.col("source").alias("node"), "target", "of", "path", (~_is("source", "Promoter") & (F.size("path") == 2)).alias("direct"))
    own = met.select("node").distinct().where(_is("node", "Promoter")).join(known.withColumnRenamed("target", "node"), "node").select("node", F.col("node").alias("target"), "of", F.array("node").alias("path"), F.lit(True).alias("direct"))
    every = steps.unionByName(own)
    lists = every.groupBy("node").agg(*[F.array_sort(F.collect_list(F.when(F.col("direct") == d, F.col("of")))).alias(k) for d, k in ((True, "direct_genes"), (False, "indirect_genes"))])
    targets = met.join(lists, "node").select("region_id", F.col("node").alias("anchor"), "direct_genes", "indirect_genes")
    indirect = met.join(steps.where("NOT direct"), "node").select("region_id", F.col("node").alias("anchor"), F.col("of").alias("genes"), "path")
    return targets, indirect


def pair_classes(pets: DataFrame, enhancers: DataFrame, promoters: DataFrame, ext: int = 50) -> DataFrame:
    """kind and n: cis and trans pairs by what their ends, ``ext`` to both sides, touch: of half-open enhancers and promoters (chrom, start, end).

    Each end meets the few runs of its tile as one row, so pairs stay single rows.
    """
    known = None
    for kind, spans in (("e", enhancers), ("p", promoters)):
        # [pos - ext, pos + ext) meets [start, end) where pos is from start - ext + 1 to end + ext - 1
        grown = intervals.stitch(spans.where("start < end").select("chrom", (F.col("start") - ext + 1).alias("start"), (F.col("end") + ext - 1).alias("end")), 0)
        one = grown.select("chrom", "start", "end", F.lit(kind).alias("what"))
        known = one if known is None else known.unionByName(one)
    tiles = known.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / NEAR), F.floor(F.col("end") / NEAR))))
    runs = {k: F.collect_list(F.when(F.col("what") == k, F.struct("start", "end"))) for k in "ep"}
    tiles = tiles.groupBy("chrom", "tile").agg(*[c.alias(k) for k, c in runs.items()])
    flags = pets.select("chrom_a", "chrom_b", "x", "y")
    for side, at in (("a", "x"), ("b", "y")):
        here = tiles.select(F.col("chrom").alias(f"chrom_{side}"), F.col("tile").alias("_t"), *[F.col(k).alias(f"_{k}") for k in "ep"])
        flags = flags.withColumn("_t", F.floor(F.col(at) / NEAR)).join(here, [f"chrom_{side}", "_t"], "left")
        pos = F.col(at)
        met = {f"{side}{k}": F.coalesce(F.exists(f"_{k}", lambda r: pos.between(r["start"], r["end"])), F.lit(False)) for k in "ep"}
        flags = flags.withColumns(met).drop("_t", "_e", "_p")
    ae, ap, be, bp = (F.col(c) for c in ("ae", "ap", "be", "bp"))
    name = (
        F.when((ae & bp) | (ap & be), "Enhancer-Promoter").when(ae & be, "Enhancer-Enhancer").when(ap & bp, "Promoter-Promoter")
        .when((ae & ~be & ~bp) | (be & ~ae & ~ap), "Enhancer-Other").when((ap & ~be & ~bp) | (bp & ~ae & ~ap), "Promoter-Other").otherwise("Other-Other")
    )
    return flags.groupBy(name.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
