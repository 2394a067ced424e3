"""The command line: ``python -m contactloom COMMAND ...``.

A library is a folder that ``pre`` writes; results are folders of tab-separated text
(``PREFIX_name``) and drawings (``PREFIX_name.svg``). Numbers of processes are the
session's matter, so there is no option for them.
"""

from __future__ import annotations

import argparse
import logging
import shutil
import subprocess
import sys
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom import datasets, figures
from contactloom.operators import annotate, cluster, compare, differential, domains, estimates, intervals, matrix, peaks, pets, profiles, quantify, reads, selection, signals
from contactloom.operators import loops as lp
from contactloom.session import local_session, prepare
from contactloom.sources import bigwig, formats, tracks

log = logging.getLogger("contactloom")


def numbers(text: str, turned: bool = False, keep: bool = False) -> tuple[int, ...]:
    """Whole numbers parted by commas, in order (``turned``: largest first; ``keep``: as given)."""
    out = [int(x) for x in str(text).split(",")]
    return tuple(out if keep else sorted(out, reverse=turned))


def limits(text: str) -> list[tuple[float, float] | None]:
    """Lower and upper limits of several axes, ``a,b;c,d``; an empty one is None."""
    return [tuple(float(v) for v in part.split(",")) if part else None for part in text.split(";")] if text else []


def has_tool(name: str) -> bool:
    return shutil.which(name) is not None


def run_tool(*words: str) -> None:
    """Another program, such as an aligner or a packer of tracks; an error if it is missing or fails."""
    if not has_tool(words[0]):
        raise FileNotFoundError(f"{words[0]} is not installed")
    log.info(" ".join(words))
    subprocess.run(words, check=True)


def timed(name: str, of: Callable[[], None]) -> None:
    start = time.time()
    of()
    log.info("%s: %.1f s", name, time.time() - start)


COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]], str]] = {}
_FLAG = {"action": "store_true"}
_DATA = [("-d", {"dest": "data", "required": True, "help": "library"}), ("-cut", {"type": int, "default": 0}), ("-mcut", {"type": int, "default": -1})]


def command(name: str, *options: tuple[str, dict]):
    def add(of: Callable) -> Callable:
        COMMANDS[name] = (of, [("-o", {"dest": "out", "default": "contactloom_output"}), *options], (of.__doc__ or "").strip())
        return of

    return add


def _open(spark: SparkSession, a, path: str | None = None, chroms: tuple[str, ...] = ()) -> DataFrame:
    return datasets.pairs(spark, path or a.data, a.cut, a.mcut, chroms)


def _write(rows: DataFrame, a, name: str, header: bool = True) -> None:
    tracks.write_text(rows, f"{a.out}_{name}", header=header)


def _files(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def _signal(spark: SparkSession, path: str) -> DataFrame:
    return bigwig.read_bigwig(spark, path) if path.endswith((".bw", ".bigWig")) else formats.read_bedgraph(spark, path)


def _raw(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return formats.read_pairs(spark, path) if kind == "pairs" else formats.read_bedpe(spark, path)


@command("qc", ("-f", {"dest": "files", "required": True}))
def qc(spark, a):
    """Counts and ratios of BEDPE files before any filter."""
    rows = None
    for path in _files(a.files):
        r = formats.bedpe_rows(spark, path, 6).withColumns({"pos_a": F.expr("(start_a + end_a) div 2"), "pos_b": F.expr("(start_b + end_b) div 2"), "library": F.lit(path.rsplit("/", 1)[-1].split(".bedpe")[0])})
        rows = r if rows is None else rows.unionByName(r)
    _write(pets.quality(rows), a, "bedpeQc")


@command("pre", ("-f", {"dest": "files", "required": True}), ("-c", {"dest": "chroms", "default": ""}), ("-trans", _FLAG), ("-mapq", {"type": int, "default": 10}), ("-format", {"dest": "kind", "default": "bedpe", "choices": ["bedpe", "pairs"]}), *_DATA[1:])
def pre(spark, a):
    """Unique pairs of BEDPE or pairs files as a library."""
    rows = spark_union([_raw(spark, f, a.kind) for f in _files(a.files)])
    how = {"mapq": a.mapq if a.kind == "bedpe" else 0, "chroms": tuple(_files(a.chroms)), "cut": a.cut, "mcut": a.mcut, "cis_only": not a.trans}
    canonical = pets.canonical(rows)
    datasets.write(pets.unique(pets.keep(canonical, **how)), a.out, pets.ingest_counts(canonical, **how))


def spark_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@command("update", _DATA[0])
def update(spark, a):
    """Count the pairs of a library again."""
    datasets.refresh(spark, a.data)


@command("combine", ("-ds", {"dest": "several", "required": True}), ("-keep", {"type": int, "default": 1}))
def combine(spark, a):
    """Several libraries as one, with at most ``-keep`` copies of a pair (0: all)."""
    rows = pets.combine([datasets.pairs(spark, d) for d in _files(a.several)], a.keep)
    datasets.write(datasets.of_keys(rows), a.out)


_DUMPS = ("bed", "bedpe", "washU", "ucsc", "hic", "bdg", "mat", "virtual4C")


@command("dump", *_DATA, *[(f"-{d}", _FLAG) for d in _DUMPS], *[(f"-{d}_ext", {"type": int, "default": 50}) for d in ("bed", "bedpe", "washU", "ucsc", "bdg")], ("-bdg_pe", _FLAG), ("-mat_res", {"type": int, "default": 5000}), ("-mat_chrom", {"default": ""}), ("-mat_start", {"type": int, "default": -1}), ("-mat_end", {"type": int, "default": -1}), ("-m", {"dest": "method", "default": "obs", "choices": ["obs", "obs/exp"]}), ("-log", _FLAG), ("-corr", _FLAG), ("-norm", _FLAG), *[(f"-virtual4C_{k}", {"type": int, "default": -1}) for k in ("start", "end")], ("-virtual4C_chrom", {"default": ""}), ("-view_start", {"type": int, "default": -1}), ("-view_end", {"type": int, "default": -1}))
def dump(spark, a):
    """Pairs as BED, BEDPE, long-range, interact, short or bedGraph text, a matrix, or the links of a view point."""
    rows = _open(spark, a)
    if a.bed:
        _write(tracks.bed_lines(rows, a.bed_ext).sort("chrom", "start"), a, "reads.bed", False)
    if a.bedpe:
        _write(tracks.bedpe_lines(rows, a.bedpe_ext), a, "PETs.bedpe", False)
    if a.washU:
        _write(tracks.link_lines(rows, a.washU_ext).sort("chrom", "start"), a, "PETs_washU", False)
    if a.ucsc:
        _write(tracks.interact_lines(rows, a.ucsc_ext).sort("chrom", "start"), a, "PETs_interact", False)
    if a.hic:
        _write(tracks.short_lines(rows).sort("chrom_a", "chrom_b"), a, "PETs_short", False)
    if a.bdg:
        _write(tracks.bedgraph_lines(rows, datasets.total(spark, a.data), a.bdg_ext, a.bdg_pe).sort("chrom", "start"), a, "bdg", False)
    if a.mat:
        start, end = _window(rows, a.mat_chrom, a.mat_start, a.mat_end)
        matrix.contact_matrix(rows, a.mat_chrom, start, end, a.mat_res, 5 if a.method == "obs/exp" else 0, a.log, a.corr, a.norm).to_csv(f"{a.out}_cmat.txt", sep="\t", index_label="pos")
    if a.virtual4C:
        start, end = _window(rows, a.virtual4C_chrom, a.virtual4C_start, a.virtual4C_end)
        _write(profiles.virtual_4c(rows, a.virtual4C_chrom, start, end, a.view_start, a.view_end).select("chrom", "start", "end", "log2_depth").sort("start"), a, "4C.bdg", False)


def _window(rows: DataFrame, key: str, start: int, end: int) -> tuple[int, int]:
    """The window, with the extent of the key for what is below zero."""
    least, most = rows.where(F.col("key") == key).agg(F.min("x"), F.max("y")).first()
    return (least or 0) if start < 0 else start, (most or 0) if end < 0 else end


@command("estEps", *_DATA, ("-k", {"type": int, "default": 5}), ("-method", {"default": "gmm", "choices": ["gmm", "k-dis"]}))
def est_eps(spark, a):
    """A distance to cluster with, from a mixture of distances or the knee of neighbour distances."""
    rows = _open(spark, a)
    eps = estimates.mixture_eps(rows) if a.method == "gmm" else estimates.knee_eps(rows, a.k)
    values = estimates._drawn(rows.where("dist > 0").select(F.log2("dist").alias("d"), "x"), "d", "x")["d"] if a.method == "gmm" else estimates._drawn(estimates.neighbour_distances(rows, a.k).where("kdis > 0").select(F.log2("kdis").alias("d"), "x"), "d", "x")["d"]
    figures.histogram({"pairs": values}, title=f"eps {eps}", xlabel="log2 distance").save(f"{a.out}_eps.svg")
    log.info("eps %d", eps)


@command("estRes", *_DATA, ("-bs", {"dest": "sizes", "default": "5000"}))
def est_res(spark, a):
    """Shares of singletons and fingerprints for bin sizes."""
    rows, sizes = _open(spark, a), numbers(a.sizes)
    _write(matrix.resolution(rows, sizes), a, "estRes")
    # slices before the first whole cell hold nothing
    shares = {str(s): matrix.fingerprint(rows, s, diagonal=False).toPandas().set_index("slice")["share"].reindex(range(1, 101), fill_value=0) for s in sizes}
    figures.curves(range(1, 101), shares, "share of pairs in the poorest cells", "% of cells").save(f"{a.out}_estRes.svg")


@command("estDis", *_DATA, ("-c", {"dest": "chroms", "default": ""}), ("-bs", {"type": int, "default": 5000}), ("-r", {"dest": "repeats", "type": int, "default": 10}), ("-plot", _FLAG))
def est_dis(spark, a):
    """Pairs by distance against shuffled ends."""
    got = estimates.distance_enrichment(_open(spark, a, chroms=tuple(_files(a.chroms))), a.bs, a.repeats).orderBy("distance")
    _write(got, a, "obsExpDisFreq")
    if a.plot:
        p = got.toPandas()
        d = figures.curves(p["distance"], {"observed": p["observed"], "expected": p["expected"]}, "pairs by distance")
        figures.curves(p["distance"], {"ratio": p["ratio"].astype(float)}, drawing=d).save(f"{a.out}_disFreq.svg")


@command("estSat", *_DATA, ("-bs", {"dest": "sizes", "default": "5000"}), ("-tol", {"type": int, "default": 5}))
def est_sat(spark, a):
    """Cells that are found again in samples."""
    got = estimates.saturation(_open(spark, a), numbers(a.sizes), a.tol).orderBy("bin_size", "ratio", "repeat")
    _write(got, a, "estSat")
    p = got.groupBy("ratio").pivot("bin_size").agg(F.avg("share")).orderBy("ratio").toPandas()
    figures.curves(p["ratio"], {c: p[c] for c in p.columns[1:]}, "cells found again", "share of pairs").save(f"{a.out}_estSat.svg")


@command("estSim", ("-ds", {"dest": "several", "required": True}), *_DATA[1:], ("-bs", {"type": int, "default": 5000}), ("-m", {"dest": "method", "default": "pcc", "choices": ["pcc", "pca"]}), ("-pcut", {"type": int, "default": 2}), ("-n", {"type": int, "default": 2}), ("-plot", _FLAG))
def est_sim(spark, a):
    """Correlations of several libraries."""
    samples = {d.rstrip("/").rsplit("/", 1)[-1]: _open(spark, a, d) for d in _files(a.several)}
    if a.method == "pca":
        got = estimates.principal_similarity(samples, a.bs, a.n)
    else:
        told = matrix.similarity(samples, a.bs, a.pcut).toPandas()
        got = pd.DataFrame(1.0, index=list(samples), columns=list(samples))
        for r in told.itertuples():
            got.loc[r.sample_a, r.sample_b] = got.loc[r.sample_b, r.sample_a] = r.pcc
    got.to_csv(f"{a.out}_{a.method.upper()}.txt", sep="\t", index_label="sample")
    if a.plot and len(samples) == 2 and a.method == "pcc":
        one, two = samples
        cells = estimates._drawn(matrix.shared_cells(samples, a.bs, a.pcut), one, two)
        figures.clouds({"cells": (cells[one], cells[two])}, f"correlation {got.iloc[0, 1]:.3f}", one, two).save(f"{a.out}_PCC.svg")
    elif a.plot:
        figures.heatmap(got, "correlation", low=0, high=1).save(f"{a.out}_{a.method.upper()}.svg")


@command("filterPETs", *_DATA, ("-peaks", {"default": ""}), ("-loops", {"default": ""}), ("-singleton", _FLAG), ("-knn", _FLAG), ("-bs", {"type": int, "default": 5000}), ("-eps", {"type": int, "default": 1000}), ("-minPts", {"type": int, "default": 5}), ("-gap", {"type": int, "default": 1}), ("-iv", {"dest": "inverse", "action": "store_true"}), ("-both", _FLAG))
def filter_pets(spark, a):
    """Pairs on peaks or loops (or not), without singletons, or without noise."""
    if sum(map(bool, (a.peaks, a.loops, a.singleton, a.knn))) != 1:
        raise ValueError("give one of -peaks, -loops, -singleton and -knn")
    rows = _open(spark, a)
    if a.peaks:
        kept = intervals.touching(rows, formats.read_bed(spark, a.peaks), a.inverse, a.gap)
    elif a.loops:
        known = formats.read_loops(spark, a.loops).where("cis")
        kept = datasets.of_points(intervals.joining(rows, known, a.inverse)) if a.both else intervals.touching(rows, intervals.anchors(known), a.inverse, a.gap)
    else:
        kept = datasets.of_keys(matrix.without_singletons(rows, a.bs) if a.singleton else cluster.denoised(rows, a.eps, a.minPts))
    datasets.write(kept, a.out)


@command("samplePETs", *_DATA, ("-tot", {"type": int, "required": True}), ("-seed", {"type": int, "default": 0}))
def sample_pets(spark, a):
    """A library of about ``-tot`` pairs."""
    datasets.write(pets.sample_to(_open(spark, a).where("dist IS NOT NULL"), a.tot, a.seed), a.out)


@command("callPeaks", *_DATA, ("-eps", {"default": "100,200"}), ("-minPts", {"default": "5"}), ("-pcut", {"type": float, "default": 1e-2}), ("-bgd", {"dest": "control", "default": ""}), ("-bgm", {"dest": "model", "default": "lf", "choices": ["ratio", "lf"]}), ("-sen", _FLAG), ("-split", _FLAG), ("-splitExt", {"type": int, "default": 50}))
def call_peaks(spark, a):
    """Peaks, with or without a control library."""
    control = _open(spark, a, a.control) if a.control else None
    got = peaks.call(_open(spark, a), numbers(a.eps), numbers(a.minPts, True), a.pcut, control, a.model == "ratio", a.sen, a.split, a.splitExt).checkpoint()
    _write(tracks.peak_lines(got), a, "peaks")
    _write(tracks.peak_bed_lines(got).sort("chrom", "start"), a, "peaks.bed", False)


@command("callLoops", *_DATA, ("-eps", {"required": True}), ("-minPts", {"required": True}), ("-emPair", _FLAG), ("-hic", _FLAG), ("-filter", _FLAG), ("-trans", _FLAG), ("-i", {"dest": "ucsc", "action": "store_true"}), ("-j", {"dest": "juicebox", "action": "store_true"}), ("-w", {"dest": "washU", "action": "store_true"}))
def call_loops(spark, a):
    """Loops within, and with ``-trans`` also between, chromosomes."""
    eps, least = numbers(a.eps, keep=a.emPair), numbers(a.minPts, True, a.emPair)
    if 0 in eps or 0 in least:
        raise ValueError("-eps and -minPts must be above zero")
    rows = _open(spark, a)
    got = lp.call_cis(rows, eps, least, a.cut, a.hic, a.emPair).checkpoint()
    _loops(got, a, "loops")
    if a.filter:
        datasets.write(lp.on_anchors(rows, got, max(eps)), f"{a.out}_filtered")
    if a.trans:
        _loops(lp.call_trans(datasets.pairs(spark, a.data), eps, least).checkpoint(), a, "trans_loops")


def _loops(got: DataFrame, a, name: str) -> None:
    _write(tracks.loop_lines(got), a, name)
    for wanted, lines, end in ((a.ucsc, tracks.loop_interact_lines, "ucsc"), (a.juicebox, tracks.loop_box_lines, "juicebox"), (a.washU, tracks.loop_link_lines, "legacyWashU"), (a.washU, tracks.loop_mirror_lines, "newWashU")):
        if wanted:
            _write(lines(got), a, f"{name}_{end}", "W" not in end)


@command("callDiffLoops", ("-tloop", {"required": True}), ("-cloop", {"required": True}), ("-td", {"required": True}), ("-cd", {"required": True}), *_DATA[1:], ("-pcut", {"type": float, "default": 1e-2}), ("-igp", _FLAG), ("-noPCorr", _FLAG), ("-fdr", {"type": float, "default": 0.1}), ("-customize", _FLAG), ("-cacut", {"type": float, "default": 0.0}), ("-cmcut", {"type": float, "default": 0.0}), ("-j", {"dest": "juicebox", "action": "store_true"}), ("-w", {"dest": "washU", "action": "store_true"}))
def call_diff_loops(spark, a):
    """Loops that differ between two libraries."""
    names = [d.rstrip("/").rsplit("/", 1)[-1] for d in (a.td, a.cd)]
    known = [formats.read_loops(spark, f).where("cis") for f in (a.tloop, a.cloop)]
    rows = [_open(spark, a, d) for d in (a.td, a.cd)]
    got = differential.call(*rows, *known, *names, a.fdr, a.pcut, (a.cacut, a.cmcut) if a.customize else None, a.igp, a.noPCorr).checkpoint()
    sets = {"dloops": got, f"{names[0]}_specific_dloops": got.where("significant = 1 AND scaled_fc > 0"), f"{names[1]}_specific_dloops": got.where("significant = 1 AND scaled_fc < 0")}
    for name, of in sets.items():
        _write(tracks.diff_loop_lines(of), a, name)
        if a.juicebox:
            _write(tracks.diff_box_lines(of, False), a, f"{name}_juicebox")
        if a.washU:
            _write(tracks.diff_mirror_lines(of, False), a, f"{name}_newWashU", False)
    p = got.where("scaled_rab > 0 AND rab_c > 0").select("scaled_rab", "rab_c", "scaled_fc", "p", "significant").toPandas()
    groups = {n: p[p["significant"] == s] for n, s in (("all", 0), ("significant", 1))}
    figures.clouds({n: ((_log2(g["scaled_rab"]) + _log2(g["rab_c"])) / 2, g["scaled_fc"]) for n, g in groups.items()}, "means and differences", "A", "M").save(f"{a.out}_MA.svg")
    figures.clouds({n: (g["scaled_fc"], -_log2(g["p"].clip(lower=1e-300)) / 3.321928) for n, g in groups.items()}, "fold changes", "log2 fold change", "-log10 p").save(f"{a.out}_volcano.svg")
    for name, r in zip(names, rows, strict=True):
        mean, _ = differential.mean_tiles(profiles.loop_tiles(r, got.select("loop_id", "chrom", *lp.BOX)))
        figures.heatmap(mean, name, both=True).save(f"{a.out}_{name}_aggLoops.svg")


def _log2(values: pd.Series) -> pd.Series:
    return np.log2(values)


@command("callDomains", *_DATA, ("-bs", {"dest": "sizes", "default": "10000"}), ("-ws", {"dest": "windows", "default": "500000"}), ("-strict", _FLAG))
def call_domains(spark, a):
    """Domains, and the scores they are made from."""
    rows = _open(spark, a)
    for size in numbers(a.sizes):
        for window in numbers(a.windows):
            _write(tracks.score_lines(domains.segregation(rows, size, window)).sort("chrom", "start"), a, f"domains_SS_binSize{size / 1000}k_winSize{window / 1000}k.bdg", False)
    got = domains.call(rows, numbers(a.sizes), numbers(a.windows), a.strict).checkpoint()
    _write(tracks.domain_lines(got), a, "domains")
    _write(tracks.domain_bed_lines(got).sort("chrom", "start"), a, "domains.bed", False)


_WINDOW = [("-chrom", {"required": True}), ("-start", {"type": int, "default": -1}), ("-end", {"type": int, "default": -1})]


@command("plot", *_DATA, *_WINDOW, ("-bs", {"type": int, "default": 5000}), ("-m", {"dest": "method", "default": "obs", "choices": ["obs", "obs/exp"]}), *[(f"-{k}", _FLAG) for k in ("log", "corr", "norm", "triu", "1D", "arch", "scatter", "eig", "eig_r", "virtual4C")], ("-view_start", {"type": int, "default": -1}), ("-view_end", {"type": int, "default": -1}), ("-bws", {"default": ""}), ("-beds", {"default": ""}), ("-loops", {"default": ""}), ("-domains", {"default": ""}), ("-gtf", {"default": ""}))
def plot(spark, a):
    """A window as a matrix, arches or points, with tracks."""
    key, rows = f"{a.chrom}-{a.chrom}", _open(spark, a)
    start, end = _window(rows, key, a.start, a.end)
    inside = rows.where((F.col("key") == key) & (F.col("x") >= start) & (F.col("y") <= end))
    shown = {}
    if getattr(a, "1D"):
        shown["tags per million"] = tracks.bedgraph_lines(inside, datasets.total(spark, a.data)).orderBy("start").toPandas()
    if a.virtual4C:
        shown["view point"] = profiles.virtual_4c(rows, key, start, end, a.view_start, a.view_end).select("start", "end", F.log2(F.col("depth") + 1).alias("value")).orderBy("start").toPandas()
    for f in _files(a.bws):
        shown[f.rsplit("/", 1)[-1]] = _signal(spark, f).where((F.col("chrom") == a.chrom) & (F.col("end") > start) & (F.col("start") < end)).orderBy("start").toPandas()
    below = {"signals": shown, "beds": {f.rsplit("/", 1)[-1]: formats.contained(formats.read_bed(spark, f), a.chrom, start, end).toPandas() for f in _files(a.beds)}}
    if a.gtf:
        below["known"] = formats.genes_in(formats.read_gtf(spark, a.gtf), a.chrom, start, end).toPandas()
    known = formats.read_loops(spark, a.loops).where((F.col("chrom") == a.chrom) & (F.col("start_a") >= start) & (F.col("end_b") <= end)).toPandas() if a.loops else None
    title = f"{a.chrom}:{start}-{end}"
    if a.arch or a.scatter:
        p = inside.select("x", "y").orderBy(F.xxhash64("x", "y")).limit(figures.SHOWN).toPandas()
        d = (figures.arches if a.arch else figures.scatter)(p, start, end, title, loops=known, **below)
    else:
        mat = matrix.contact_matrix(rows, key, start, end, a.bs, 5 if a.method == "obs/exp" else 0, a.log, a.corr, a.norm)
        doms = formats.contained(formats.read_bed(spark, a.domains), a.chrom, start, end).toPandas() if a.domains else None
        both = a.corr or a.norm or a.method == "obs/exp"
        d = figures.matrix_window(mat, start, end, a.bs, a.triu, both, known, doms, a.eig or a.eig_r, a.eig_r, title, **below)
    d.save(f"{a.out}_plot.svg")


@command("montage", *_DATA, ("-bed", {"required": True}), ("-ext", {"type": float, "default": 2}), ("-vp", {"default": ""}), ("-ppmw", {"type": float, "default": 10}), ("-no1D", _FLAG))
def montage(spark, a):
    """Pairs between named regions, as tables and around a circle."""
    rows = _open(spark, a)
    known = formats.read_bed(spark, a.bed).where("name IS NOT NULL").select(F.col("name").alias("region_id"), "chrom", "start", "end")
    got = profiles.region_links(rows, known, datasets.total(spark, a.data)).checkpoint()
    _write(got.select("id_a", "id_b", "n"), a, "counts")
    _write(got.select("id_a", "id_b", "per_million"), a, "interactionPETsPerMillion")
    table = known.withColumnRenamed("region_id", "name").toPandas()
    c = figures.montage(table, got.toPandas(), a.ext, a.ppmw, _files(a.vp))
    if not a.no1D:
        grown = known.select("region_id", "chrom", (F.col("start") - a.ext * (F.col("end") - F.col("start"))).cast("long").alias("start"), (F.col("end") + a.ext * (F.col("end") - F.col("start"))).cast("long").alias("end"))
        for name, g in profiles.tag_profiles(intervals.points(rows), grown, 100).toPandas().groupby("region_id"):
            w = (2 * a.ext + 1) * float((table["end"] - table["start"])[table["name"] == name].iloc[0]) / 100
            c.signal(name, g["bin"] * w, (g["bin"] + 1) * w, g["value"].tolist())
    c.save(f"{a.out}_montage.svg")


@command("agg", *_DATA, *[(f"-{k}", {"default": ""}) for k in ("peaks", "loops", "viewPoints", "twoAnchors", "domains", "bws")], ("-peak_ext", {"type": int, "default": 5000}), ("-peak_bins", {"type": int, "default": 100}), ("-loop_ext", {"type": int, "default": 10}), ("-loop_cut", {"type": int, "default": 0}), ("-viewPointUp", {"type": int, "default": 100000}), ("-viewPointDown", {"type": int, "default": 100000}), ("-viewPointBs", {"type": int, "default": 1000}), ("-twoAnchor_ext", {"type": float, "default": 0.1}), ("-domain_ext", {"type": float, "default": 0.5}), ("-bins", {"type": int, "default": 100}), ("-1D", _FLAG), ("-norm", _FLAG))
def agg(spark, a):
    """Mean profiles and matrices of peaks, loops, view points, anchors and domains."""
    rows, total = _open(spark, a), datasets.total(spark, a.data)
    bed = lambda f: formats.read_bed(spark, f).select("region_id", "chrom", "start", "end")
    points = intervals.points(rows)

    def along(name: str, windows: DataFrame, turn=None) -> None:
        """Tags and signals along the windows, as means over them."""
        if not getattr(a, "1D"):
            return
        n = windows.count()
        lines = {"tags per million": profiles.mean_profile(profiles.tag_profiles(points, windows, a.bins), n, a.bins).withColumn("value", F.col("value") / (2 * total) * 1e6)}
        for f in _files(a.bws):
            lines[f.rsplit("/", 1)[-1]] = profiles.mean_profile(profiles.signal_profiles(_signal(spark, f), windows, a.bins, turn), n, a.bins)
        table = {k: v.orderBy("bin").toPandas()["value"] for k, v in lines.items()}
        pd.DataFrame(table).to_csv(f"{a.out}_{name}_1D.txt", sep="\t", index_label="bin")
        figures.curves(range(a.bins), table, name).save(f"{a.out}_{name}_1D.svg")

    def cells(name: str, of: DataFrame, n: int, id: str = "region_id") -> None:
        _write(of, a, name)
        got = profiles.mean_cells(of, n, a.norm, id).toPandas()
        if len(got):
            figures.heatmap(got.pivot(index="i", columns="j", values="value").fillna(0), f"{name}, {n} regions").save(f"{a.out}_{name}.svg")

    if a.peaks:
        known = bed(a.peaks)
        got = profiles.peak_profiles(rows, known, total, a.peak_ext, a.peak_bins)
        _write(got, a, "aggPeaks")
        p = got.toPandas()
        if len(p):
            figures.profile_rows(p.pivot(index="region_id", columns="bin", values="value").fillna(0), "tags around peaks, per million").save(f"{a.out}_aggPeaks.svg")
    if a.loops:
        known = formats.read_loops(spark, a.loops, a.loop_cut).where("cis")
        cells("aggLoops", profiles.loop_tiles(rows, known, a.loop_ext), known.count(), "loop_id")
        along("aggLoops", profiles.anchor_windows(known, a.loop_ext))
    if a.viewPoints:
        known = bed(a.viewPoints)
        cells("aggViewPoints", profiles.viewpoint_cells(rows, known, a.viewPointUp, a.viewPointDown, a.viewPointBs), known.count())
        mid = (F.col("start") + F.col("end")) / 2
        along("aggViewPoints", known.select("region_id", "chrom", (mid - a.viewPointUp).alias("start"), (mid + a.viewPointDown).alias("end")).where("start > 0"))
    if a.twoAnchors:
        known = formats.read_loops(spark, a.twoAnchors, a.loop_cut).where("cis")
        windows = profiles.span_windows(known, a.twoAnchor_ext)
        cells("aggTwoAnchors", profiles.span_tiles(rows, windows), windows.count())
        turned = known.select(F.col("loop_id").alias("region_id"), (F.col("start_a") + F.col("end_a") > F.col("start_b") + F.col("end_b")).alias("turned"))
        along("aggTwoAnchors", windows.join(turned, "region_id"), F.col("turned"))
    if a.domains:
        windows = profiles.domain_windows(bed(a.domains), a.domain_ext)
        cells("aggDomains", profiles.span_tiles(rows, windows), windows.count())
        along("aggDomains", windows)


@command("quant", *_DATA, ("-peaks", {"default": ""}), ("-loops", {"default": ""}), ("-offP", _FLAG), ("-domains", {"default": ""}), ("-domain_bs", {"type": int, "default": 10000}), ("-domain_ws", {"type": int, "default": 500000}), ("-domain_bdg", _FLAG))
def quant(spark, a):
    """Given peaks, loops and domains in a library."""
    rows, total = _open(spark, a), datasets.total(spark, a.data)
    if a.peaks:
        known = formats.read_bed(spark, a.peaks).select(F.col("region_id").alias("peak_id"), "chrom", "start", "end", (F.col("end") - F.col("start")).alias("length"))
        _write(tracks.quant_peak_lines(quantify.peaks(rows, known, total)), a, "peaks")
    if a.loops:
        _write(tracks.loop_lines(quantify.loops(rows, formats.read_loops(spark, a.loops).where("cis"), total, a.offP), True), a, "loops")
    if a.domains:
        known = formats.read_domains(spark, a.domains)
        got = quantify.domains(rows, known, total, a.domain_bs, a.domain_ws).withColumns({"bin_size": F.lit(a.domain_bs), "win_size": F.lit(a.domain_ws)})
        _write(tracks.domain_lines(got), a, "domains")
        if a.domain_bdg:
            _write(tracks.score_lines(domains.segregation(rows, a.domain_bs, a.domain_ws)).sort("chrom", "start"), a, "SS.bdg", False)


@command("anaLoops", ("-loops", {"required": True}), ("-gtf", {"required": True}), ("-tid", _FLAG), ("-pdis", {"type": int, "default": 2000}), ("-net", _FLAG), ("-gap", {"type": int, "default": 1}))
def ana_loops(spark, a):
    """Genes at loops, and the network of their anchors."""
    known, genes = formats.read_loops(spark, a.loops).where("cis"), formats.read_gtf(spark, a.gtf, a.tid)
    named = genes.withColumn("gene_id", F.format_string("%s:%d-%d|%s|%s", "chrom", "start", "end", "strand", "gene_name"))
    got = annotate.loop_genes(known, named, a.pdis)
    _write(got.withColumns({f"genes_{s}": F.array_join(f"genes_{s}", ",") for s in "ab"}), a, "LoopsGtfAno")
    if a.net:
        anchors = annotate.merged_anchors(known, named, a.pdis, a.gap).checkpoint()
        of = annotate.loop_anchors(known, anchors).checkpoint()
        edges = annotate.links(of).checkpoint()
        _write(anchors.withColumn("genes", F.array_join("genes", ",")), a, "mergedAnchors")
        _write(anchors.select("chrom", "start", "end", "anchor"), a, "mergedAnchors.bed", False)
        _write(of, a, "loop2anchors")
        _write(tracks.network_lines(edges), a, "ep_net.sif", False)
        _write(tracks.target_lines(annotate.promoter_targets(edges), anchors), a, "targets")


@command("findTargets", ("-net", {"required": True}), ("-tg", {"dest": "targets", "required": True}), ("-bed", {"default": ""}))
def find_targets(spark, a):
    """Genes that regions reach through the network."""
    if a.bed:
        edges, known = formats.read_network(spark, a.net), formats.read_targets(spark, a.targets)
        got, paths = annotate.region_targets(edges, known, formats.read_bed(spark, a.bed).select("region_id", "chrom", "start", "end"))
        _write(got.withColumns({c: F.array_join(c, ",") for c in ("direct_genes", "indirect_genes")}), a, "targetGenes")
        _write(paths.withColumn("path", F.array_join("path", ",")), a, "indirectTargetGenesPathes")


# what comes as scripts beside the commands


def _scores(name: str, of: Callable, value: str, size: int, step: int):
    @command(name, *_DATA, ("-bs", {"type": int, "default": size}), ("-step", {"type": int, "default": step}))
    def run(spark, a):
        _write(tracks.score_lines(of(_open(spark, a), a.bs, a.step), value).sort("chrom", "start"), a, "bdg", False)

    run.__doc__ = f"{value} along chromosomes as bedGraph."


_scores("getDI", matrix.directionality, "di", 10_000, 100_000)
_scores("getIS", matrix.insulation, "z", 10_000, 100_000)
_scores("getSS", domains.segregation, "ss", 1_000, 50_000)
_scores("getLocalIDS", matrix.local_density, "ids", 1_000, 10)


@command("getFRiF", *_DATA, ("-bed", {"default": ""}), ("-loop", {"default": ""}), ("-single", _FLAG))
def frif(spark, a):
    """Shares of pairs in regions and in loops."""
    rows, total = _open(spark, a), datasets.total(spark, a.data)
    if a.bed:
        got = quantify.share_in_regions(rows, formats.read_bed(spark, a.bed), a.single)
        _write(got.select("hits", F.lit(total).alias("pets"), (F.col("hits") / (total * (2 if a.single else 1))).alias("share")), a, "1d_FRiF")
    if a.loop:
        n = intervals.loop_counts(rows, formats.read_loops(spark, a.loop).where("cis")).agg(F.sum("pets").alias("hits"))
        _write(n.select("hits", F.lit(total).alias("pets"), (F.col("hits") / total).alias("share")), a, "2d_FRiF")


@command("getIntDensity", *_DATA, ("-bed", {"required": True}))
def int_density(spark, a):
    """Local and distal tags of regions."""
    _write(quantify.regions(_open(spark, a), formats.read_bed(spark, a.bed)), a, "quant")


@command("getPETsAno", *_DATA, ("-enhancer", {"required": True}), ("-promoter", {"required": True}), ("-ext", {"type": int, "default": 50}))
def pets_ano(spark, a):
    """Pairs by what their ends touch."""
    _write(annotate.pair_classes(_open(spark, a), formats.read_bed(spark, a.enhancer), formats.read_bed(spark, a.promoter), a.ext), a, "PETsAno")


@command("getSigDist", *_DATA, ("-bs", {"type": int, "default": 1000}))
def sig_dist(spark, a):
    """Cells by the number of their pairs."""
    _write(estimates.cell_histogram(_open(spark, a), a.bs).orderBy("n"), a, "sigDist")


@command("getSigEnrich", *_DATA, ("-bs", {"type": int, "default": 5000}), ("-r", {"dest": "repeats", "type": int, "default": 3}))
def sig_enrich(spark, a):
    """Fingerprints, observed and of shuffled ends."""
    got = estimates.enrichment_curves(_open(spark, a), a.bs, a.repeats).orderBy("slice").checkpoint()
    _write(got, a, "sigEnrich")
    p = got.toPandas()
    figures.curves(p["slice"], {"observed": p["observed"], "expected": p["expected"]}, "share of pairs in the poorest cells").save(f"{a.out}_sigEnrich.svg")


@command("showAggVPs", *_DATA, ("-bed", {"required": True}), ("-up", {"type": int, "default": 100000}), ("-down", {"type": int, "default": 100000}), ("-bs", {"type": int, "default": 1000}))
def show_viewpoints(spark, a):
    """The mean matrix around view points, in logarithms."""
    known = formats.read_bed(spark, a.bed)
    got = profiles.mean_cells(profiles.viewpoint_cells(_open(spark, a), known, a.up, a.down, a.bs), known.count()).withColumn("value", F.log2(F.col("value") + 1)).toPandas()
    figures.heatmap(got.pivot(index="i", columns="j", values="value").fillna(0), "view points, log2").save(f"{a.out}_aggVPs.svg")


@command("plotDiffHeatmap", ("-da", {"required": True}), ("-db", {"required": True}), *_DATA[1:], *_WINDOW, ("-bs", {"type": int, "default": 5000}), ("-norm", _FLAG))
def plot_diff(spark, a):
    """The log2 ratio of two libraries in a window, as shares of their pairs."""
    key, rows = f"{a.chrom}-{a.chrom}", [_open(spark, a, d) for d in (a.da, a.db)]
    start, end = _window(rows[0], key, a.start, a.end)
    one, two = (matrix.contact_matrix(r, key, start, end, a.bs) / max(datasets.total(spark, d), 1) * 1e6 for r, d in zip(rows, (a.da, a.db), strict=True))
    diff = _log2((two + 1) / (one + 1))
    figures.matrix_window(diff, start, end, a.bs, both=True, title=f"{a.chrom}:{start}-{end}").save(f"{a.out}_diff.svg")


@command("mergeDomains", ("-fs", {"dest": "files", "required": True}), ("-r", {"dest": "share", "type": float, "default": 0.9}))
def merge_domains(spark, a):
    """Domains of several files, coarse before fine: a later one replaces an earlier one that it covers."""
    rows = spark_union([formats.read_bed(spark, f).select("chrom", "start", "end", F.lit(float(i)).alias("ss"), F.lit(i).alias("rank"), "region_id") for i, f in enumerate(_files(a.files))])
    _write(selection.merged_domains(rows, a.share).select("chrom", "start", "end", "region_id").sort("chrom", "start"), a, "mergedDomains.bed", False)


@command("anoPeaks", ("-f", {"dest": "bed", "required": True}), ("-gtf", {"required": True}), ("-tid", _FLAG), ("-pdis", {"type": int, "default": 2000}))
def ano_peaks(spark, a):
    """Genes at peaks."""
    named = formats.read_gtf(spark, a.gtf, a.tid).withColumn("gene_id", F.format_string("%s:%d-%d|%s|%s", "chrom", "start", "end", "strand", "gene_name"))
    known = formats.read_bed(spark, a.bed)
    _write(known.join(annotate.starts_of(known, named, a.pdis), "region_id").withColumn("genes", F.array_join("genes", ",")), a, "anoPeaks")


@command("compareComp", ("-a", {"dest": "one", "required": True}), ("-b", {"dest": "two", "required": True}), ("-na", {"default": "a"}), ("-nb", {"default": "b"}), ("-gtf", {"default": ""}), ("-pcut", {"type": float, "default": 0.01}))
def compare_comp(spark, a):
    """Compartments of two signals, and the bins that change."""
    one, two = formats.read_bedgraph(spark, a.one), formats.read_bedgraph(spark, a.two)
    runs = [domains.compartments(s).checkpoint() for s in (one, two)]
    for name, r in zip((a.na, a.nb), runs, strict=True):
        _write(r.sort("chrom", "start"), a, f"{name}_compartments.bed", False)
    got = compare.compartment_bins(one, two, a.pcut).checkpoint()
    _write(got, a, "MD_p-values")
    _write(got.select("chrom", "start", "end", (-F.log10(F.greatest(F.col("p"), F.lit(1e-300)))).alias("value")).sort("chrom", "start"), a, "-logP.bdg", False)
    genes = formats.read_gtf(spark, a.gtf).withColumn("gene_id", F.col("gene_name")) if a.gtf else None
    p = got.select("value_a", "value_b", "flip").toPandas()
    figures.clouds({"all": (p["value_a"], p["value_b"])} | {k: (g["value_a"], g["value_b"]) for k, g in p.groupby("flip")}, f"p below {a.pcut}", a.na, a.nb, lines=((0, None), (None, 0))).save(f"{a.out}_bins_flips.svg")
    for flip in ("AtoB", "BtoA", "AtoA", "BtoB"):
        some = got.where(F.col("flip") == flip).orderBy("p")
        some = compare.annotated_bins(some, runs[0], genes).withColumn("genes", F.array_join("genes", ",")) if genes is not None else some
        _write(some, a, f"{flip}_bins")


@command("compareDom", ("-bed", {"required": True}), ("-da", {"required": True}), ("-db", {"required": True}), *_DATA[1:], ("-gtf", {"default": ""}), ("-pcut", {"type": float, "default": 0.01}))
def compare_dom(spark, a):
    """Domains in two libraries, and those specific to one."""
    rows = [_open(spark, a, d) for d in (a.da, a.db)]
    known = formats.read_bed(spark, a.bed)
    got = compare.domains(*rows, known, a.pcut).checkpoint()
    _write(got, a, "domainQuant")
    p = got.select("es_a", "es_b", "specific").toPandas()
    figures.clouds({"all": (p["es_a"], p["es_b"])} | {f"specific to {k}": (g["es_a"], g["es_b"]) for k, g in p.groupby("specific")}, "enrichment", a.da, a.db).save(f"{a.out}_changes.svg")
    genes = formats.read_gtf(spark, a.gtf).withColumn("gene_id", F.col("gene_name")) if a.gtf else None
    for side in "ab":
        some = got.where(F.col("specific") == side).withColumn("region_id", F.col("domain_id"))
        _write(some.select("chrom", "start", "end", "domain_id"), a, f"{side}_specific.bed", False)
        for name, r in zip("ab", rows, strict=True):
            of = profiles.span_tiles(r, profiles.domain_windows(some, 0.25))
            m = profiles.mean_cells(of, some.count(), True).toPandas()
            if len(m):
                figures.heatmap(m.pivot(index="i", columns="j", values="value").fillna(0), f"domains of {side} in {name}").save(f"{a.out}_{side}_in_{name}.svg")
        if genes is not None:
            _write(some.join(compare.overlapping_genes(some, genes), "region_id", "left").withColumn("genes", F.array_join("genes", ",")), a, f"{side}_specificDomains")


@command("tow", ("-br", {"required": True}), ("-bt", {"required": True}), ("-wr", {"required": True}), ("-wt", {"required": True}), ("-ext", {"type": int, "default": 10}))
def tow(spark, a):
    """Two signals made comparable by their peaks and background."""
    known = [formats.read_bed(spark, f) for f in (a.br, a.bt)]
    signal = [_signal(spark, f) for f in (a.wr, a.wt)]
    back = signals.shifted_regions(*known, a.ext).checkpoint()
    shared = signals.shared_regions(*known).checkpoint()
    table = {n: signals.signal_to_noise(s, shared, back).orderBy("bin").toPandas()["ratio"] for n, s in zip(("reference", "target"), signal, strict=True)}
    figures.curves(range(100), table, "signal to noise", "bin").save(f"{a.out}_qc.svg")
    for name, rows in zip(("ref", "tgt"), signals.normalise(*signal, *known, a.ext), strict=True):
        _write(rows.select("chrom", "start", "end", "value").sort("chrom", "start"), a, f"{name}.bdg", False)


def _convert(name: str, read: Callable, to: Callable, ext: int):
    @command(name, ("-f", {"dest": "file", "required": True}), ("-ext", {"type": int, "default": ext}))
    def run(spark, a):
        tracks.write_text(to(read(spark, a.file), a.ext), f"{a.out}.bedpe", compress=True)

    run.__doc__ = "Pairs of another format as BEDPE."


_convert("hicpro2bedpe", formats.read_valid_pairs, formats.valid_pairs_to_bedpe, 50)
_convert("juicerLong2bedpe", formats.read_juicer_long, formats.juicer_long_to_bedpe, 50)
_convert("getBedpeFBed", formats.read_bed, formats.bed_to_bedpe, 150)


@command("cutLinkers", ("-1", {"dest": "one", "required": True}), ("-2", {"dest": "two", "required": True}), ("-linker", {"default": reads.LINKER}), ("-rlen", {"type": int, "default": 10}))
def cut_linkers(spark, a):
    """Paired reads without linkers, for an aligner."""
    sides = [reads.read_fastq(spark, f).withColumn("name", F.substring_index("name", " ", 1)) for f in (a.one, a.two)]
    both = sides[0].toDF("name", "seq_a", "qual_a").join(sides[1].toDF("name", "seq_b", "qual_b"), "name")
    got = reads.cut_linkers(both, a.rlen, a.linker).checkpoint()
    for s, k in (("a", "R1"), ("b", "R2")):
        got.select(F.concat(F.lit("@"), "name", F.lit("\n"), f"seq_{s}", F.lit("\n+\n"), f"qual_{s}")).write.mode("overwrite").option("compression", "gzip").text(f"{a.out}_{k}.fastq")


@command("uniqueBedpe", ("-f", {"dest": "file", "required": True}), ("-linker", _FLAG))
def unique_bedpe(spark, a):
    """BEDPE rows once each; with ``-linker`` near and trans pairs need a linker."""
    rows = formats.bedpe_rows(spark, a.file, 6)
    got = formats.linker_bedpe(rows) if a.linker else formats.unique_bedpe(rows)
    tracks.write_text(got.select("chrom_a", "start_a", "end_a", "chrom_b", "start_b", "end_b", "name", "mapq", "strand_a", "strand_b"), f"{a.out}.bedpe", compress=True)


@command("baitReads", ("-f", {"dest": "file", "required": True}), ("-bait", {"required": True}), ("-enz", {"dest": "site", "required": True}), ("-miss", {"type": int, "default": 2}), ("-rlen", {"type": int, "default": 10}))
def bait_reads(spark, a):
    """What follows the bait and a cutting site, for an aligner."""
    got = reads.baited(reads.read_fastq(spark, a.file), a.bait, a.site, a.miss, a.rlen)
    got.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.mode("overwrite").option("compression", "gzip").text(f"{a.out}.fastq")


@command("baitCoverage", ("-f", {"dest": "file", "required": True}), ("-chrom", {"required": True}), ("-frags", {"default": ""}), ("-cis", _FLAG), ("-log", _FLAG))
def bait_coverage(spark, a):
    """Unique aligned reads of a bait: counts, depth, and fragments."""
    rows = formats.read_bed(spark, a.file)
    _write(reads.read_counts(rows, a.chrom), a, "stat")
    once = reads.unique_reads(rows, a.chrom, a.cis).checkpoint()
    _write(reads.read_coverage(once, max(once.count(), 1), a.log).sort("chrom", "start"), a, "bdg", False)
    if a.frags:
        _write(reads.fragments_of(once, formats.read_bed(spark, a.frags).withColumn("name", F.coalesce("name", F.lit(".")))), a, "frags", False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("contactloom", description="Interaction analytics on Spark.")
    several = top.add_subparsers(dest="command", required=True)
    for name, (_, options, about) in COMMANDS.items():
        one = several.add_parser(name, help=about, description=about)
        for flag, how in options:
            one.add_argument(flag, **how)
    return top


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Run one command in the session given, or in the one that is there, or in a local one."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    a = parser().parse_args(sys.argv[1:] if words is None else words)
    session = prepare(spark or SparkSession.getActiveSession() or local_session())
    timed(a.command, lambda: COMMANDS[a.command][0](session, a))
